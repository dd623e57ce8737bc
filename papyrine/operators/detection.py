"""File types of documents: extension rules first, then a classifier, or byte signatures where there is none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions.blake3 import blake3_hex
from ..providers import Classifier, loaded
from ..schema import null


def classified(files: DataFrame, model: Classifier, block: int = 4096) -> DataFrame:
    """files with label, confidence and origin by a classifier. Empty and short inputs are decided by rule.

    Only the other rows' features reach the model, in Arrow batches; it is loaded once for each Python worker.
    """
    labels, thresholds = model.labels, model.thresholds
    prepared = D.features(block, model.begin, model.end, model.padding)(D.edge_sample(F.col("content"), block))  # all that features reads: large files don't cross to Python whole
    rows = files.withColumn("_features", prepared)
    ruled = D.short_label(F.col("content"), F.col("_features"), model.least, block, model.padding)

    def run(features: pd.Series) -> pd.Series:
        out, live = pd.Series([None] * len(features), dtype=object), features[features.notna()]
        if len(live):
            scores = loaded(model).scores(list(live))
            if len(scores) != len(live):
                raise ValueError("the model gave another number of rows than it got")
            for i, s in zip(live.index, scores, strict=True):
                out[i] = s
        return out

    rows = rows.withColumn("_ruled", ruled)
    rows = rows.withColumn("_scores", F.pandas_udf(run, "array<float>")(F.when(F.col("_ruled").isNull(), F.col("_features"))))
    best = D.argmax(F.col("_scores"))
    name = F.get(F.array(*[F.lit(x) for x in labels]), best["index"].cast("int"))
    own = D.decided(name, best["score"], F.coalesce(F.try_element_at(D._map(thresholds), name), F.lit(0.0)) if thresholds else F.lit(0.0), model.overwrite)
    heic = D.heic_override(own, F.lit("model"), best["score"], F.col("content"))
    rule = F.struct(F.col("_ruled").alias("label"), F.lit("rule").alias("origin"), F.lit(1.0).cast("float").alias("confidence"))
    bad = F.struct(F.lit("unknown").alias("label"), F.lit("invalid").alias("origin"), F.lit(0.0).cast("float").alias("confidence"))
    rows = rows.withColumn("_type", F.when(F.col("_ruled").isNotNull(), rule).when(best["valid"], heic).otherwise(bad))
    return rows.select(*files.columns, "_type.label", "_type.confidence", "_type.origin")


def detect_types(files: DataFrame, model: Classifier | None = None) -> DataFrame:
    """files (content, path where known) with label, confidence, origin.

    Without a model the types that no rule decides come from byte signatures (origin ``signature``). A null content
    has no type.
    """
    path = F.col("path") if "path" in files.columns else null("string")
    rows = files.withColumn("_rule", D.extension_label(D.extension_of(path), F.col("content")))
    if model is None:
        label = F.coalesce("_rule", D.signature_label(F.col("content")))
        sure = F.when(F.col("_rule").isNotNull(), "rule").when(F.length("content") == 0, "rule").otherwise("signature")
        out = rows.withColumn("label", F.when(F.col("content").isNotNull(), label)).withColumn("confidence", F.lit(1.0).cast("float")).withColumn("origin", F.when(F.col("label").isNotNull(), sure))
        return out.drop("_rule")
    ruled = rows.filter("_rule is not null").withColumn("label", F.col("_rule")).withColumn("confidence", F.lit(1.0).cast("float")).withColumn("origin", F.lit("rule")).drop("_rule")
    return ruled.union(classified(rows.filter("_rule is null").drop("_rule"), model).select(ruled.columns))


def described(files: DataFrame, model: Classifier | None = None) -> DataFrame:
    """files with label, confidence, origin, mime_type, description, is_text."""
    rows = detect_types(files, model)
    of = lambda i: F.try_element_at(D._map({k: v[i] for k, v in D.TYPES.items()}), F.col("label"))
    return rows.withColumns({"mime_type": of(0), "description": of(2), "is_text": of(3)})


def metadata_of(rows: DataFrame, hashed: bool = True) -> Column:
    """The metadata struct of described rows; its hash is the BLAKE3 of the whole content (null if not hashed)."""
    path = F.col("path") if "path" in rows.columns else null("string")
    own = blake3_hex(F.col("content")) if hashed else null("string")
    made = F.struct(D.stem_of(path).alias("stem"), D.extension_of(path).alias("extension"), "label", "mime_type", "description", "is_text", "confidence", "origin", own.alias("hash"))
    return F.when(F.col("label").isNotNull(), made)


def with_metadata(files: DataFrame, model: Classifier | None = None, hashed: bool = True) -> DataFrame:
    """files with a metadata struct."""
    rows = described(files, model)
    return rows.select(*files.columns, metadata_of(rows, hashed).alias("metadata"))
