"""Licence notices found by conditional compression and confirmed by their wording.

A candidate block is the text around a cue, on either side as far as a notice
can reach. Its words are compressed once alone and once with each notice as
zstandard raw dictionary; notices are ranked by the bytes they save, and those
that save a fair share of their own size are tried in that order. The first one
is the finding whose words, in order, differ from a stretch of the block that holds the
cue by at most a tenth of them, in no number and in no word that tells licences
apart; the missing and the added words are returned, so that an exact wording
can be told from a variant. Case, punctuation, line ends, comment marks and the numbers or
letters of list items are no wording. A name that goes on after the stretch, as in
``MIT-0``, is another licence. Identifier lines name their licences themselves.

Defined cases: null and empty texts have no findings; equal savings rank the longer notice first, then by
name; a null doc_id stays null; repeated rows are scanned again; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.license_notices import CUES, DECIDING, NOTICES
from kerbline.llm.texts import blocks

FINDING = "struct<license:string,begin:int,stop:int,saved:double,n_missing:int,n_added:int,missing:string,added:string>"
_WORDS = re.compile(r"[^\W_]+")
#: Numbers and letters of list items, at the start of a line or sentence.
_ITEM = re.compile(r"(?:^[^\w\n]*|[:;.]\s{1,2})\(?([0-9]{1,2}|[a-z]|[ivx]{2,4})[.)](?=\s+[A-Z\"'])", re.M)
_BEFORE_VERSION = frozenset("version versions v license licence gpl lgpl agpl".split())
_IDENTIFIER = r"\(?([A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?)"
# on the next line only what looks like an identifier
_LINE = re.compile(r"(?i:SPDX-License-Identifier:)(?:[ \t]*(?=[^\s#*/;-])|[\s#*/;-]*(?=\(?(?:[^\s]*[0-9-]|[A-Z]{2})))" + _IDENTIFIER)
_FURTHER = re.compile(r"\)?\s+(?:OR|AND)\s+" + _IDENTIFIER)
_LATER = re.compile(r"(?:-only|-or-later|\+)$")


@dataclass(frozen=True)
class Finding:
    license: str
    begin: int
    stop: int
    saved: float
    missing: tuple[str, ...]
    added: tuple[str, ...]


def _fit(notice: list[str], block: list[str]) -> tuple[int, int, int]:
    """(differences, begin, stop) of the stretch of the block nearest to the notice, the shortest of equal ones."""

    def last(a: list[str], b: list[str]) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        words = np.array(b, object)
        for word in a:
            kept = np.append(len(a) + len(b), row[:-1] + (words != word))
            row = np.minimum.accumulate(np.minimum(row + 1, kept) - steps) + steps
        return row

    ends = last(notice, block)
    stop = int(ends.argmin())
    begin = stop - int(last(notice[::-1], block[:stop][::-1]).argmin())
    return int(ends[stop]), begin, stop


def wording(text: str, low: int = 0, high: int | None = None) -> list[re.Match]:
    """Words of a stretch of text, without the marks of list items."""
    high = len(text) if high is None else high
    found = list(_WORDS.finditer(text, low, high))
    marks = {m.start(1) for m in _ITEM.finditer(text, low, high)}
    return [w for k, w in enumerate(found) if w.start() not in marks or k and found[k - 1][0].lower() in _BEFORE_VERSION] if marks else found


class Scanner:
    """Notices with their dictionaries; made once a task."""

    def __init__(self, notices: dict[str, tuple[str, ...]] = NOTICES, cues: str = CUES, tolerance: float = 0.1):
        import zstandard

        self.tolerance = tolerance
        self.cue = re.compile(cues, re.I)
        self.notices = sorted(((name, text) for name, texts in notices.items() for text in texts), key=lambda x: (-len(x[1]), x))
        self.words = [[w[0].lower() for w in wording(text)] for _, text in self.notices]
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, text in self.notices]
        self.usual = [i for i, (_, text) in enumerate(self.notices) if not _LINE.match(text)]
        plain = [" ".join(self.words[i]).encode() for i in self.usual]
        empty = len(self.alone.compress(b""))
        self.size = [len(self.alone.compress(p)) - empty for p in plain]
        self.ranking = []
        for p in plain:
            own = zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=3)
            self.ranking.append(zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=own))
        self.reach = [len(text) * 5 // 4 + 20 for _, text in self.notices]
        self.longest = max(self.reach)

    def saved(self, part: str, i: int) -> tuple[int, float]:
        """Bytes of the compressed part that the notice saves, and their share."""
        data = " ".join(part.split()).encode("utf-8", "replace")
        alone = len(self.alone.compress(data))
        spared = alone - len(self.given[i].compress(data))
        return spared, spared / alone

    def ranked(self, words: list[str], least: float = 0.25) -> list[int]:
        """Notices that save at least this share of their own size of the compressed words, the largest savings first."""
        block = " ".join(words).encode("utf-8", "replace")
        alone = len(self.alone.compress(block))
        saved = [alone - len(one.compress(block)) for one in self.ranking]
        return [self.usual[k] for k in sorted((k for k in range(len(saved)) if saved[k] >= least * self.size[k]), key=lambda k: -saved[k])]

    def named(self, text: str, line: re.Match) -> list[Finding]:
        """The licences that an identifier line names; ``-only``, ``-or-later`` and ``+`` are no part of a name."""
        import zstandard

        out, begin = [], line.start()
        while line:
            own = zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(f"SPDX-License-Identifier: {line[1]}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            part = " ".join(text[begin : line.end(1)].split()).encode("utf-8", "replace")
            alone = len(self.alone.compress(part))
            out.append(Finding(_LATER.sub("", line[1].lower()), begin, line.end(1), (alone - len(own.compress(part))) / alone, (), ()))
            line = _FURTHER.match(text, line.end(1))
            begin = line.start(1) if line else 0
        return out

    def confirm(self, text: str, words: list[re.Match], cue: re.Match, i: int) -> Finding | None:
        """The stretch of the words that holds the cue, if it is near enough to the notice."""
        notice, reach = self.words[i], self.reach[i]
        words = [w for w in words if w.start() >= cue.start() - reach and w.end() <= cue.end() + reach]
        while True:
            own = [w[0].lower() for w in words]
            apart, begin, stop = _fit(notice, own)
            if stop <= begin or apart > self.tolerance * len(notice):
                return None
            # a nearer stretch before or after the cue belongs to another cue
            if words[begin].start() >= cue.end():
                words = words[:begin]
            elif words[stop - 1].end() <= cue.start():
                words = words[stop:]
            else:
                break
        missing, added = [], []
        for kind, a, b, c, d in difflib.SequenceMatcher(None, notice, own[begin:stop], autojunk=False).get_opcodes():
            if kind != "equal":
                missing += notice[a:b]
                added += own[begin + c : begin + d]
        if any(c.isdigit() for word in missing for c in word):  # another version
            return None
        pairs = set(zip(own[begin:stop], own[begin + 1 : stop]))
        if DECIDING & {*missing, *added} or ("gnu", "library") in pairs or any(c.isdigit() for word in notice for c in word) and any(w.isdigit() and len(w) < 3 for w in added):  # another licence or version
            return None
        at, end = words[begin].start(), words[stop - 1].end()
        if text[end : end + 1] == "-" and text[end + 1 : end + 2].isalnum():  # the name goes on
            return None
        return Finding(self.notices[i][0], at, end, self.saved(text[at:end], i)[1], tuple(missing), tuple(added))

    def scan(self, text: str) -> tuple[int, list[Finding]]:
        """(candidate blocks, confirmed findings) of a whole text, from left to right."""
        candidates, found, done, floor = 0, [], -1, 0
        lines = {m.start() + len("SPDX-"): m for m in _LINE.finditer(text)}
        for cue in self.cue.finditer(text):
            if cue.start() < done:
                continue
            candidates += 1
            done = cue.end()
            if cue.start() in lines:
                found += self.named(text, lines[cue.start()])
                done = floor = max(done, found[-1].stop)
                continue
            # cut words at the ends of the block are none of a notice within reach
            words = wording(text, max(floor, cue.start() - self.longest), cue.end() + self.longest)
            for i in self.ranked([w[0].lower() for w in words]):
                finding = self.confirm(text, words, cue, i)
                if finding:
                    found.append(finding)
                    done = floor = max(done, finding.stop)
                    break
        return candidates, found


def scan(docs: DataFrame, notices: dict[str, tuple[str, ...]] = NOTICES, cues: str = CUES, tolerance: float = 0.1) -> DataFrame:
    """doc_id, n_candidates and the array of findings of each document; places count code points."""

    def run(batches):
        scanner = Scanner(notices, cues, tolerance)
        for batch in blocks(batches):
            counts, rows = [], []
            for text in batch.column("text").to_pylist():
                n, found = scanner.scan(text) if text else (0, [])
                counts.append(n)
                rows.append([{"license": f.license, "begin": f.begin, "stop": f.stop, "saved": f.saved, "n_missing": len(f.missing), "n_added": len(f.added), "missing": " ".join(f.missing), "added": " ".join(f.added)} for f in found])
            kind = pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int32()), ("stop", pa.int32()), ("saved", pa.float64()), ("n_missing", pa.int32()), ("n_added", pa.int32()), ("missing", pa.string()), ("added", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int32()), pa.array(rows, kind)], names=["doc_id", "n_candidates", "findings"])

    text = F.col("text").cast("string")
    # only texts with a cue travel to Python
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(f"(?iu){cues}"), text).alias("text"))
    return given.mapInArrow(run, f"doc_id long, n_candidates int, findings array<{FINDING}>")


def licenses(docs: DataFrame) -> DataFrame:
    """Per document: candidates, findings, the licences found and how their wording differs."""
    found = scan(docs)
    total = lambda name: F.aggregate("findings", F.lit(0), lambda s, f: s + f[name])
    return found.select(
        "doc_id", "n_candidates", F.size("findings").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["license"]))), ",").alias("licenses"),
        (total("n_missing") + total("n_added")).alias("n_differences"), F.coalesce(F.array_max(F.transform("findings", lambda f: f["saved"])), F.lit(0.0)).alias("saved"),
        F.array_join(F.transform("findings", lambda f: F.concat_ws("-", f["begin"].cast("string"), f["stop"].cast("string"))), ",").alias("spans"),
    )
