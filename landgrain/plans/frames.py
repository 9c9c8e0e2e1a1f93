"""The stand-in's tables, step by step; each query builds the ones it needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import clusters, comparables, confidence, features, inference, scaling, segments
from ..sources.properties import star_properties
from ..sources.staging import staged


#: What confidence, explanations and reports read of a row, besides its comparables
JUDGED = ("row_id", "tong_gia", "nam", "segment_key", "pho_canonical", "access_band", "assigned_cluster", "coord_match_status", "coord_flags", "location_flags", "target_flags", "neighbor_count_1000m", "special_asset_flag", "special_asset_score", "segment_heterogeneity_flag")


class Frames:
    """Lazy frames over one folder of star-schema tables. Tables at segment grain, a row per street, are written once, as are the larger steps."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config = Config()) -> None:
        self.spark, self.sf_dir, self.config = spark, sf_dir, config

    @cached_property
    def raw(self) -> DataFrame:
        return star_properties(self.spark, self.sf_dir)

    @cached_property
    def keyed(self) -> DataFrame:
        return staged(segments.with_keys(self.raw), "keyed")

    @cached_property
    def train(self) -> DataFrame:
        return self.keyed.where("split = 'train'")

    @cached_property
    def clean(self) -> DataFrame:
        """Rows with a value, which alone may be candidates or be fitted to."""
        return self.train.where("tong_gia > 0")

    @cached_property
    def master(self) -> DataFrame:
        return staged(segments.segment_master(self.train, segments.coordinate_dictionary(self.keyed)), "master")

    @cached_property
    def neighbors(self) -> DataFrame:
        return staged(segments.segment_neighbors(self.master, self.config), "neighbors")

    @cached_property
    def neighbor_features(self) -> DataFrame:
        return staged(segments.neighbor_features(self.neighbors), "neighbor_features")

    @cached_property
    def frequencies(self) -> DataFrame:
        return staged(features.frequencies(self.train), "frequencies")

    @cached_property
    def heterogeneity(self) -> DataFrame:
        return staged(features.heterogeneity(self.clean), "heterogeneity")

    @cached_property
    def templates(self) -> DataFrame:
        return staged(features.heterogeneity_templates(self.heterogeneity), "templates")

    def located(self, rows: DataFrame) -> DataFrame:
        return segments.attach_segments(rows, self.master, train=True)

    def engineered(self, rows: DataFrame) -> DataFrame:
        return features.engineer(rows, self.frequencies)

    def attached(self, rows: DataFrame) -> DataFrame:
        """Rows with coordinates, features, dispersion and neighbours."""
        out = features.attach_heterogeneity(self.engineered(self.located(rows)), self.heterogeneity, self.templates)
        return segments.attach_neighbors(out, self.neighbor_features)

    def described(self, rows: DataFrame) -> DataFrame:
        """Rows with what is attached, a stand-in cluster and special-asset columns."""
        return clusters.special_assets(self.clustered(self.attached(rows)))

    @staticmethod
    def clustered(rows: DataFrame) -> DataFrame:
        """Deterministic stand-in clusters, so that what follows a clustering can be compared exactly."""
        k = F.col("row_id") % 4
        return rows.withColumns({"cluster": k.cast("int"), "assigned_cluster": k.cast("int"), "cluster_confidence": (F.col("row_id") % 10) / 10.0, "cluster_center_distance_raw": (F.col("row_id") % 13) / 8.0, "distance_to_cluster_center": (F.col("row_id") % 13) / 8.0, "local_embedding_density": (F.col("row_id") % 6) / 5.0})

    @cached_property
    def embedding(self) -> DataFrame:
        rows = self.clustered(segments.attach_neighbors(self.located(self.train), self.neighbor_features))
        rows = rows.withColumns({"spectral_1": (F.col("row_id") % 17) / 17.0, "spectral_2": (F.col("row_id") % 5) / 5.0})
        return staged(inference.segment_embedding(rows, ["spectral_1", "spectral_2"]), "embedding")

    @cached_property
    def scaled(self) -> DataFrame:
        """All described rows with their scaled vectors, fitted on the train rows.

        Written are the columns that take a join; what follows from a row's own columns, and compresses badly, is made anew by
        each reader. Rows of a segment lie together, as they have most columns in common.
        """
        rows = staged(self.attached(self.keyed).drop("log_tong_gia").sortWithinPartitions("segment_key", "row_id"), "described")
        rows = clusters.special_assets(self.clustered(rows.withColumn("log_tong_gia", segments.log_value())))
        train = rows.where("split = 'train'")
        for columns, name in ((scaling.CORE, "core"), (scaling.ACCESS, "access")):
            rows = scaling.scale(rows, staged(scaling.fit_scaling(train, columns), name), columns, name)
        return rows

    @cached_property
    def meeting(self) -> comparables.Meeting:
        """All train rows and the train rows with a value that they are compared with."""
        train = self.scaled.where("split = 'train'")
        return comparables.meeting(train, train.where("tong_gia > 0"), self.embedding, self.config)

    @cached_property
    def compared(self) -> DataFrame:
        """The comparables of all train rows among the train rows with a value; not written, as they are larger than what follows from them."""
        return comparables.found(self.meeting, self.config)

    @cached_property
    def summaries(self) -> DataFrame:
        """Written are the measures that they follow from."""
        return comparables.summary(comparables.measures(self.meeting, self.config), self.config)

    @cached_property
    def meeting_test(self) -> comparables.Meeting:
        """All test rows, new segments among them, and the train rows with a value."""
        candidates = self.scaled.where("split = 'train' and tong_gia > 0")
        return comparables.meeting(self.scaled.where("split = 'test'"), candidates, self.embedding, self.config, exclude_self=False)

    @cached_property
    def compared_test(self) -> DataFrame:
        """The comparables of all test rows; not written."""
        return comparables.found(self.meeting_test, self.config, exclude_self=False)

    @cached_property
    def summaries_test(self) -> DataFrame:
        return comparables.summary(comparables.measures(self.meeting_test, self.config, exclude_self=False), self.config)

    @cached_property
    def judged(self) -> DataFrame:
        """Train rows with bands, confidence and, as the prediction, the band's median; not written, so that each reader joins only the columns it uses."""
        return self._judged(lambda rows: rows)

    def judged_parts(self) -> Iterator[DataFrame]:
        """The judged rows in as many parts as the search has rounds, for readers that keep little of each."""
        n = self.meeting.rounds
        for k in range(n):
            yield self._judged(lambda rows: rows.where(F.pmod(F.xxhash64("row_id"), F.lit(n)) == k))  # noqa: B023

    def _judged(self, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        rows = of(self.scaled.where("split = 'train'").select(*JUDGED)).join(of(self.summaries), "row_id", "left").withColumn("predicted", F.col("total_value_band_median"))
        rows = rows.withColumns({"case_type": F.lit("CASE_1_SEGMENT_IN_TRAIN"), "assigned_cluster_method": F.lit("SEGMENT_LOOKUP")})
        return confidence.add_errors(confidence.add_confidence(rows))

    @cached_property
    def roads(self) -> DataFrame:
        """A stand-in road for every street segment with a coordinate: three points through it."""
        m = self.master.where("segment_lat_for_model is not null")
        k = F.pmod(F.length("segment_key") * 7, F.lit(5)) - 2
        point = lambda dx, dy: F.struct((F.col("segment_lon_for_model") + dx).alias("lon"), (F.col("segment_lat_for_model") + dy).alias("lat"))
        return m.select(F.col("segment_key").alias("osmid"), F.array(F.col("pho"), F.lit(None).cast("string")).alias("name"), F.array(point(-0.012, -0.003 * k), point(0.0005 * k, 0.0001), point(0.009, 0.004 * k)).alias("points"))


_known: dict[tuple[str, str, str], Frames] = {}


def frames(spark: SparkSession, sf_dir: str, config: Config = Config()) -> Frames:
    """The frames of a folder, shared by the queries of one application, so that written tables are built once."""
    key = (spark.sparkContext.applicationId, sf_dir, repr(config))
    if key not in _known:
        for old in [k for k in _known if k[0] != key[0]]:
            del _known[old]
        _known[key] = Frames(spark, sf_dir, config)
    return _known[key]
