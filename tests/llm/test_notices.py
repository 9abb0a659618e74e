"""Notices as files carry them: wrapped, after other words, side by side."""

import textwrap

import pytest

from kerbline.llm import license_scan
from kerbline.llm.license_notices import NOTICES

SCANNER = license_scan.Scanner()


def names(text):
    return [f.license for f in SCANNER.scan(text)[1]]


@pytest.mark.parametrize("width", [20, 40, 60, 72, 100])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices_are_found(width, mark):
    for name, texts in NOTICES.items():
        for text in texts:
            assert names("Foo bar.\n" + textwrap.indent(textwrap.fill(text, width, break_long_words=False, break_on_hyphens=False), mark) + "\nMore prose.") == [name], text


def test_notices_after_other_words_are_found():
    assert names("This file is part of the Foo project and is licensed under the MIT License.") == ["mit"]
    assert names("Copyright (c) 2020 by the many authors of a project with a long name " * 20 + NOTICES["isc"][0]) == ["isc"]
    assert names("Released under the MIT  License. Licensed under CC BY-NC 4.0. Released under the MIT License.") == ["mit", "cc-by-nc-4.0", "mit"]


HEADER = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."


@pytest.mark.parametrize(("kind", "version", "name"), [("", "2", "gpl-2.0"), ("", "3", "gpl-3.0"), ("Lesser ", "2.1", "lgpl-2.1"), ("Lesser ", "3", "lgpl-3.0"), ("Affero ", "3", "agpl-3.0")])
def test_relatives_of_a_licence_have_their_own_name(kind, version, name):
    for subject in ("program", "library"):
        if (subject, name[0]) != ("library", "g") and (subject, name[0]) != ("library", "a"):
            assert names(HEADER.format(subject, kind, version)) == [name]
    assert names(f"This work is licensed under the GNU {kind}General Public License, version {version}.") == [name]


def test_creative_commons_are_told_apart():
    own = {"": "cc-by-4.0", "-NonCommercial": "cc-by-nc-4.0", "-ShareAlike": "cc-by-sa-4.0", "-NoDerivatives": "cc-by-nd-4.0", "-NonCommercial-ShareAlike": "cc-by-nc-sa-4.0", "-NonCommercial-NoDerivatives": "cc-by-nc-nd-4.0"}
    for kind, name in own.items():
        assert names(f"This work is licensed under a Creative Commons Attribution{kind} 4.0 International License.") == [name]
    assert names("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 4.0 International License.") == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]), ("// SPDX-License-Identifier: LGPL-2.1-or-later\n", ["lgpl-2.1"]), ("# SPDX-License-Identifier: ISC", ["isc"]), ("SPDX-License-Identifier: MPL-2.0.", ["mpl-2.0"]),
        ("SPDX-License-Identifier: MIT-0", ["mit-0"]), ("SPDX-License-Identifier: BSD-3-Clause-Clear", ["bsd-3-clause-clear"]), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["mit", "apache-2.0"]), ("SPDX-License-Identifier: GPL-3.0+", ["gpl-3.0"]),
        ("Distributed under the MIT license.", ["mit"]), ("It is licensed under the terms of the MIT license.", ["mit"]), ("Licensed under the Apache License 2.0", ["apache-2.0"]), ("Licensed under CC BY 3.0.", ["cc-by-3.0"]),
        ("Released under the MIT-0 License.", []), ("This work is licensed under a Creative Commons Attribution 4.0 Unported License.", []),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ["cc-by-3.0"]), ("SPDX-License-Identifier:", []),
    ],
)
def test_short_notices_and_identifiers(text, found):
    assert names("Some words before.\n" + text + "\nSome words after.") == found


@pytest.mark.parametrize("marks", [("*", "*", "*"), ("-", "-", "-"), ("1)", "2)", "3)"), ("a.", "b.", "c."), ("(i)", "(ii)", "(iii)")])
def test_marks_of_list_items_are_no_wording(marks):
    for name in ("bsd-2-clause", "bsd-3-clause"):
        text = NOTICES[name][0]
        for k, mark in enumerate(marks, 1):
            text = text.replace(f" {k}. ", f"\n {mark} ")
        [found] = SCANNER.scan(f"Copyright.\n{text}\nThe end.")[1]
        assert (found.license, found.missing, found.added) == (name, (), ())


def test_the_ranking_is_that_of_compressing_with_every_notice():
    import zstandard

    text = "Words of the house. " * 10 + NOTICES["gpl-3.0"][1].replace("program", "library") + " And more words of the house. " * 9 + "Licensed under CC BY 4.0."
    words = [w[0].lower() for w in license_scan.wording(text)]
    block = " ".join(words).encode()
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
    alone, empty, saved = len(plain.compress(block)), len(plain.compress(b"")), {}
    for i in SCANNER.usual:
        own = " ".join(SCANNER.words[i]).encode()
        given = zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        spared = alone - len(given.compress(block))
        if spared >= 0.25 * (len(plain.compress(own)) - empty):
            saved[i] = spared
    got = SCANNER.ranked(words)
    assert SCANNER.notices[got[0]][0] == "gpl-3.0" and "cc-by-4.0" in [SCANNER.notices[i][0] for i in got]
    assert abs(len(set(got) ^ set(saved))) <= 3 and [SCANNER.notices[i][0] for i in sorted(saved, key=lambda i: -saved[i])][:2] == [SCANNER.notices[i][0] for i in got][:2]
    assert names(text) == ["gpl-3.0", "cc-by-4.0"]
