"""A filtered view of the postings, and the statistics of what it shows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.sources.segments import latest, read_index
from termspire.sources.store import stored


@dataclass(frozen=True)
class View:
    """Postings (doc_id, field, term, tf, ...) under restrictions that all stay lazy.

    ``kept`` holds statistics of exactly these postings that are stored already; a restricted view starts without them.
    """

    postings: DataFrame
    kept: Mapping[str, DataFrame] = field(default_factory=dict, compare=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str, lang: str) -> View:
        """The whole of a language in an index, with the index's statistics; of one in several segments, with ``seg``."""
        several = (commit := latest(spark, path)) is not None and len(commit.segments) > 1
        own = lambda name: read_index(spark, path, name).where(F.col("lang") == lang).drop("lang", *["seg"] * (not several))
        return cls(own("postings"), {name: own(name) for name in ("field_terms", "lengths", "models")})

    def stored(self, name: str = "view") -> View:
        """The same view with its postings and statistics written once, for plans that read them in many places."""
        v = View(stored(self.postings.select("doc_id", "field", "term", "tf", *self._seg), f"{name}-postings"))
        return View(v.postings, {
            "field_terms": stored(v._segment_terms(), f"{name}-terms"), "lengths": stored(v.field_lengths(), f"{name}-lengths"),
            "models": stored(v.doc_model(), f"{name}-models"),
        })

    def fields(self, names: Iterable[str], negate: bool = False) -> View:
        """Only (or all but) these fields; documents without a visible field disappear."""
        test = F.col("field").isin(*names)
        return View(self.postings.where(~test if negate else test))

    def documents(self, chosen: DataFrame) -> View:
        """Only documents in ``chosen``."""
        return View(self.postings.join(chosen.select("doc_id"), "doc_id", "left_semi"))

    def terms(self, test: Callable[[Column], Column]) -> View:
        """Only terms that a predicate keeps; it may be a user's own, a pandas UDF too."""
        return View(self.postings.where(test(F.col("term"))))

    def only_terms(self, chosen: DataFrame) -> View:
        return View(self.postings.join(chosen.select("term"), "term", "left_semi"))

    def without_terms(self, stop: DataFrame) -> View:
        return View(self.postings.join(stop.select("term"), "term", "left_anti"))

    def without_common(self, threshold: float) -> View:
        from termspire.functions.termfilters import common_terms

        return self.only_terms(common_terms(self.postings, threshold))

    def having_field(self, name: str, negate: bool = False) -> View:
        """Only documents with a term in the field; ``negate`` keeps those without."""
        have = self.postings.where(F.col("field") == name).select("doc_id").distinct()
        return View(self.postings.join(have, "doc_id", "left_anti" if negate else "left_semi"))

    def doc_ids(self, fields: Iterable[str] | None = None) -> DataFrame:
        """(doc_id): documents with a term in any of the fields, by default in any visible one."""
        rows = self.kept.get("lengths", self.postings)
        return (rows.where(F.col("field").isin(*fields)) if fields else rows).select("doc_id").distinct()

    def check_fields(self, names: Iterable[str]) -> None:
        """Fails on no fields or on one that nothing has."""
        names = list(names)
        have = {r["field"] for r in self.field_terms().select("field").distinct().collect()}
        if not names or set(names) - have:
            raise ValueError(f"unknown fields: {sorted(set(names) - have)}" if names else "no fields")

    # Statistics

    @property
    def _seg(self) -> list[str]:
        return ["seg"] * ("seg" in self.postings.columns)

    def _segment_terms(self) -> DataFrame:
        """(field, term, tf, df[, seg]): a posting is a document's, so counting rows counts documents."""
        if "field_terms" in self.kept:
            return self.kept["field_terms"].select("field", "term", "tf", "df", *self._seg)
        return self.postings.groupBy("field", "term", *self._seg).agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))

    def field_terms(self) -> DataFrame:
        """(field, term, tf, df), over all segments."""
        rows = self._segment_terms()
        return rows.groupBy("field", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")) if self._seg else rows

    def field_lengths(self) -> DataFrame:
        """(doc_id, field, len): tokens of each field."""
        if "lengths" in self.kept:
            return self.kept["lengths"].select("doc_id", "field", "len")
        return self.postings.groupBy("doc_id", "field").agg(F.sum("tf").alias("len"))

    def with_lengths(self) -> DataFrame:
        """Postings with ``len``, the tokens of their field: in the index they have it, a restricted view counts what it shows."""
        if "lengths" in self.kept and "len" in self.postings.columns:
            return self.postings
        return self.postings.drop("len").join(self.field_lengths(), ["doc_id", "field"])

    def by_term(self) -> DataFrame:
        """(term, tf, df): frequencies sum over fields, document frequencies take each segment's largest field and sum over segments."""
        rows = self._segment_terms().groupBy("term", *self._seg).agg(F.sum("tf").alias("tf"), F.max("df").alias("df"))
        return rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")) if self._seg else rows

    def collection(self) -> DataFrame:
        """One row: ttf, n_docs, n_uniq."""
        sums = self.by_term().agg(F.sum("tf").alias("ttf"), F.count("*").alias("n_uniq"))
        docs = self.doc_ids().agg(F.count("*").alias("n_docs"))
        return sums.crossJoin(F.broadcast(docs)).select("ttf", "n_docs", "n_uniq")  # one row each

    def by_field(self) -> DataFrame:
        """(field, ttf, utf, docs) per field, and for all of them with field null.

        The two grouping sets are the fields of each distinct term and document and, once more,
        a null field: rows are repeated after they are distinct, not before.
        """
        every = lambda names: F.explode(F.concat(names, F.array(F.lit(None).cast("string"))))
        own = self.field_terms().groupBy("term").agg(F.collect_list(F.struct("field", "tf")).alias("f"), F.sum("tf").alias("tf"))
        both = F.concat("f", F.array(F.struct(F.lit(None).cast("string").alias("field"), F.col("tf"))))
        terms = own.select(F.inline(both)).groupBy("field").agg(F.sum("tf").alias("ttf"), F.count("*").alias("utf"))
        docs = self.field_lengths().groupBy("doc_id").agg(F.collect_list("field").alias("f"))
        docs = docs.select(every("f").alias("d_field")).groupBy("d_field").agg(F.count("*").alias("docs"))
        return terms.join(docs, F.col("field").eqNullSafe(F.col("d_field"))).select("field", "ttf", "utf", "docs")

    def term_stats(self) -> DataFrame:
        """(term, tf, df, rel_tf, rel_df) of :meth:`by_term`."""
        return self.by_term().crossJoin(F.broadcast(self.collection())).select(  # one row
            "term", "tf", "df", (F.col("tf") / F.col("ttf")).alias("rel_tf"), (F.col("df") / F.col("n_docs")).alias("rel_df")
        )

    def doc_model(self, doc_tf: str = "field_presence") -> DataFrame:
        """(doc_id, term, mtf): in how many visible fields of a document a term stands, or how often."""
        if "models" in self.kept and doc_tf == "field_presence":
            return self.kept["models"].select("doc_id", "term", "mtf")
        count = F.sum("tf") if doc_tf == "occurrences" else F.count("*")
        return self.postings.groupBy("doc_id", "term").agg(count.alias("mtf"))

    def doc_lengths(self, doc_tf: str = "field_presence") -> DataFrame:
        """(doc_id, dl, n_terms)."""
        rows = self.doc_model(doc_tf)
        return rows.groupBy("doc_id").agg(F.sum("mtf").alias("dl"), F.count("*").alias("n_terms"))

    def doc_terms(self, fields: Iterable[str] | None = None, doc_id: int | None = None) -> DataFrame:
        """(doc_id, field, term): the distinct terms of each document, or of one, in these fields."""
        rows = self.postings if doc_id is None else self.postings.where(F.col("doc_id") == doc_id)
        return (rows.where(F.col("field").isin(*fields)) if fields else rows).select("doc_id", "field", "term").distinct()

    def vocabulary(self, feedback: DataFrame) -> DataFrame:
        """(q_id, term): the distinct terms of each query's feedback documents."""
        return self.doc_model().select("doc_id", "term").join(feedback.select("q_id", "doc_id"), "doc_id").select("q_id", "term").distinct()
