"""Labelled text tables: a DataFrame with the names of its text, label and id columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from pharmatext.functions.ratings import label_threshold
from pharmatext.operators import clean, collect, labelling, stats
from pharmatext.plans.ranking import with_rank
from pharmatext.plans.storage import materialize
from pharmatext.sources import text_files

REVIEW_SCHEMA = (
    "review_id bigint, site string, comment string, rating_map map<string,double>, "
    "rating_scalar double, date_raw string, drug string, url string, user_id string"
)


@dataclass(frozen=True)
class TextDataset:
    table: DataFrame
    text: str = "text"
    label: str = "label"
    id: str = "id"

    @staticmethod
    def read_csv(spark: SparkSession, path: str, text: str = "text", label: str = "label",
                 schema=None, id_col: str = "id") -> TextDataset:
        """Load and clean; the row's place in the file is its id."""
        table = text_files.read_csv(spark, path, schema, id_col)
        return TextDataset(table, text, label, id_col).clean()

    def with_table(self, table: DataFrame):
        return replace(self, table=table)

    def clean(self):
        return self.with_table(clean.clean(self.table, self.text, self.label, self.id))

    def stats(self) -> DataFrame:
        """Texts and share per label."""
        return stats.label_stats(self.table, self.label)

    def write_csv(self, path: str, mode: str = "error") -> None:
        text_files.write_csv(self.table.drop(self.id), path, mode=mode)


@dataclass(frozen=True)
class ReviewDataset(TextDataset):
    """Reviews with star ratings; ``stars`` is the star type that the labels come from."""

    text: str = "comment"
    stars: str = "effectiveness"
    num_classes: int = 2

    @staticmethod
    def empty(spark: SparkSession, **options) -> ReviewDataset:
        return ReviewDataset(spark.createDataFrame([], REVIEW_SCHEMA), id="review_id", **options)

    @staticmethod
    def read_csv(spark: SparkSession, path: str, schema=None, id_col: str = "id",
                 star_types: list[str] | None = None, **options) -> ReviewDataset:
        """Load, unpack old-format ratings, clean and label."""
        table = text_files.read_csv(spark, path, schema, id_col)
        flat = labelling.explode_ratings(table, star_types)
        return ReviewDataset(flat, id=id_col, **options).cleaned_and_labelled()

    def cleaned_and_labelled(self) -> ReviewDataset:
        """Labels come from the star type; where a site rates with one number, from that number."""
        table = self.table
        if "label" in table.columns:
            return self.with_table(clean.clean(table, self.text, "label", self.id))
        given = [F.col(c).cast("double") for c in (self.stars, "rating_scalar") if c in table.columns]
        rated = table.withColumn("_rating", F.coalesce(*given, F.lit(None).cast("double")))
        cleaned = clean.clean(rated, self.text, "_rating", self.id)
        return self.with_table(labelling.label_stars(cleaned, "_rating", self.num_classes).drop("_rating"))

    def label_by_threshold(self, positive: float = 4.0, negative: float = 2.0) -> ReviewDataset:
        label = label_threshold(self.table[self.stars], positive, negative)
        return self.with_table(labelling.add_label(self.table.drop("label"), label, drop_null=True))

    def collect(self, pages: DataFrame, collect_urls: bool = False, collect_user_ids: bool = False,
                star_types: list[str] | None = None) -> ReviewDataset:
        """Add the reviews on fetched pages, then clean and label.

        New reviews are numbered after the stored ones, in page order.
        """
        found = collect.extract_reviews(pages, collect_urls, collect_user_ids)
        return self.add(number_reviews(found, self._next_id()), star_types)

    def collect_from_urls(self, urls: DataFrame, pages: DataFrame, done: DataFrame | None = None,
                          **columns) -> ReviewDataset:
        """Collect the fetched pages whose ``url`` is listed, but not those ``done`` before."""
        wanted = collect.pages_of(pages, urls)
        return self.collect(collect.pages_to_do(wanted, done) if done is not None else wanted, **columns)

    def collect_from_names(self, names: DataFrame, results: DataFrame, pages: DataFrame,
                           **columns) -> ReviewDataset:
        """Drug names to reviews over fetched pages.

        ``results`` holds the search result pages ``(page_id, site, name, url, html)`` of one site,
        ``pages`` all other fetched pages: between pages, front pages and review pages.
        """
        hits = collect.follow_hops(materialize(collect.search_hits(results), "hits"), pages)
        urls = collect.resolve_names(names, hits).filter(F.col("url").isNotNull()).select("url")
        fronts = collect.front_pages(collect.pages_of(pages, urls))
        wanted = collect.page_frontier(fronts).select(F.col("page_url").alias("url"))
        return self.collect_from_urls(wanted, pages, **columns)

    def add(self, reviews: DataFrame, star_types: list[str] | None = None) -> ReviewDataset:
        flat = labelling.explode_ratings(reviews, star_types, "rating_map")
        stored = labelling.explode_ratings(self.table, star_types, "rating_map").drop("label")
        united = collect.append_reviews(stored, flat.withColumnRenamed("review_id", self.id))
        grown = self.with_table(united).cleaned_and_labelled()
        return grown.with_table(materialize(grown.table, "reviews"))  # later growth starts from here

    def _next_id(self) -> int:
        last = self.table.agg({self.id: "max"}).first()[0]
        return 0 if last is None else last + 1


def number_reviews(reviews: DataFrame, start: int = 0) -> DataFrame:
    """``review_id`` in the order of pages and places on them. The reviews are stored first, so the pages
    are parsed once; only page ids and places are sorted."""
    stored = materialize(reviews, "extracted")
    places = with_rank(stored.select("page_id", "pos"), ["page_id", "pos"], name="_rank")
    numbered = stored.join(places, ["page_id", "pos"])
    return numbered.select((F.lit(start) + F.col("_rank")).alias("review_id"), *[c for c in reviews.columns if c not in ("page_id", "pos")])
