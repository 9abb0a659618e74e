"""Pipeline products of one data folder, each built and written once on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.constants import ARCHIVE_BANDWIDTH
from kerbline.operators import delay, mapmatch, segments, smooth
from kerbline.operators.stage import stage
from kerbline.plans import derived

TRIP = ["trip_id"]


class Workspace:
    """Inputs and products, keyed by trip or shape, for every trip of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _derive(self, name: str) -> DataFrame:
        return stage(getattr(derived, name)(self.spark, self.sf_dir), name)

    @cached_property
    def shape_pts(self) -> DataFrame:
        return self._derive("shape_pts")

    @cached_property
    def pings(self) -> DataFrame:
        return self._derive("pings")

    @cached_property
    def stops(self) -> DataFrame:
        return self._derive("stops")

    @cached_property
    def controls(self) -> DataFrame:
        return self._derive("controls")

    @cached_property
    def motion(self) -> DataFrame:
        return self._derive("motion")

    @cached_property
    def shapes(self) -> DataFrame:
        return stage(mapmatch.shape_segments(self.shape_pts), "shapes")

    @cached_property
    def matched(self) -> DataFrame:
        return stage(mapmatch.snap_to_shape(self.pings, self.shapes), "matched")

    @cached_property
    def clocked(self) -> DataFrame:
        return stage(smooth.trip_clock(self.matched, TRIP), "clocked")

    @cached_property
    def trace(self) -> DataFrame:
        return smooth.on_route_trace(self.clocked)

    @cached_property
    def pieces(self) -> DataFrame:
        return stage(smooth.smooth_pchip(self.trace, TRIP), "pieces")

    @cached_property
    def archive_pieces(self) -> DataFrame:
        return stage(smooth.smooth_pchip(self.trace, TRIP, bandwidth=ARCHIVE_BANDWIDTH), "pieces5")

    @cached_property
    def near_stops(self) -> DataFrame:
        return stage(segments.near_side_stops(self.stops, self.controls), "near_stops")

    @cached_property
    def segs(self) -> DataFrame:
        return stage(segments.segments(self.controls), "segments")

    @cached_property
    def seg_stops(self) -> DataFrame:
        return stage(segments.segment_stops(self.near_stops, self.segs), "seg_stops")

    @cached_property
    def seg_controls(self) -> DataFrame:
        return stage(segments.segment_controls(self.controls, self.segs), "seg_controls")

    @cached_property
    def zones(self) -> DataFrame:
        return stage(segments.dwell_zones(self.seg_stops, self.seg_controls), "zones")

    @cached_property
    def facilities(self) -> DataFrame:
        return stage(segments.facility_index(self.segs, self.seg_stops, self.seg_controls, self.controls), "facilities")

    @cached_property
    def samples(self) -> DataFrame:
        return stage(smooth.sample_trajectory(self.pieces, TRIP, dt=2.0), "samples")

    @cached_property
    def events(self) -> DataFrame:
        samples = smooth.sample_trajectory(self.pieces, TRIP, dt=2.0)
        return stage(delay.slow_events(samples, TRIP), "events")

    @cached_property
    def times(self) -> DataFrame:
        return stage(delay.segment_times(self.pieces, self.segs, TRIP), "segment_times")

    @cached_property
    def freeflow(self) -> DataFrame:
        night = self.times.where(F.substring("trip_id", 2, 20).cast("long") % 3 == 0)
        return stage(delay.freeflow_table(night), "freeflow")

    @cached_property
    def attribution(self) -> tuple[DataFrame, DataFrame]:
        return delay.attributions(self.events, self.times, self.zones, self.seg_controls, TRIP)

    @cached_property
    def attributed(self) -> DataFrame:
        return self.attribution[0]

    @cached_property
    def decomposed(self) -> DataFrame:
        named, pairs = self.attribution
        rows = delay.segment_decomposition(self.times, delay.bucket_sums(named, pairs, TRIP), self.freeflow, TRIP)
        return stage(rows, "decomposed")


_open: dict[tuple[str, str], Workspace] = {}


def measured_broadcasts(spark: SparkSession) -> None:
    """Let only tables whose size was measured while the job runs be broadcast.

    Sizes estimated before are those of compressed files, and rows that an explode
    makes are not counted, so tables of gigabytes passed the threshold and filled the
    driver. The session's threshold stays, for measured sizes.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    most = spark.conf.get(planned)
    if most != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, most)
        spark.conf.set(planned, "-1")


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    measured_broadcasts(spark)
    if key not in _open:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _open[key] = Workspace(spark, sf_dir)
    return _open[key]


def forget() -> None:
    """Drop all products, so that the next query builds its whole chain."""
    _open.clear()
