"""op5: language identification by compression.

Each language has a zstandard raw-content dictionary of passages from its labelled texts, as long as they are together. A text goes whole, in blocks, through each
dictionary; the smallest total wins. The score is the relative gap to the runner-up; below the model's margin a text is
rejected. The margin is a tenth (``LEEWAY``) of the least gap at which one of the calibration rows, labelled and not in a dictionary, was still decided rightly, so that
of many more texts few clean ones fall below it, and ``MARGIN`` at least. Letters alone count: case is folded, everything else becomes a space. Every block starts with a
run that always compresses, or short blocks would all be stored raw at equal size.

Null texts and texts without a letter get ``und`` and score 0 and are rejected, and so is every text if no language was learned; with a single language every other text
gets it at score 1. Ties go to the language with more labelled rows, then the smaller name. Repeated rows are answered each. A null doc_id isn't learned from (its held_out
is null). There is a dictionary for each distinct lang, so their number must fit a worker. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, LONG, STRING, crc_mod, hold, materialize, schema, table

#: Fitting: so many labelled rows of a language, of each a passage of so many characters at a place its hash decides; calibration rows of a language.
SAMPLE_ROWS, SAMPLE_CHARS, CALIBRATION = 128, 320, 64
BLOCK, LEVEL, PAD = 2000, 12, b"\0" * 64
MARGIN, LEEWAY = 0.001, 0.1
UNDECIDED = "und"
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return f" {OTHER.sub(' ', text.lower()).strip()} ".encode()


class Model:
    """Dictionaries in order of preference at ties, and the gap below which a text is rejected."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], margin: float = MARGIN):
        self.dictionaries, self.margin, self.key = dictionaries, margin, uuid.uuid4().hex

    def compressors(self) -> list:
        out = []
        for _, data in self.dictionaries:
            own = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(data), write_content_size=False)
            out.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=own))
        return out


def fit(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, lang. Of a language at most SAMPLE_ROWS passages of SAMPLE_CHARS characters reach the driver, and CALIBRATION decisions."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string"))
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    cut = F.col("text").substr(at, F.lit(SAMPLE_CHARS))
    order = Window.partitionBy("lang").orderBy("h", "text")
    near = rows.withColumn("k", F.row_number().over(order)).where(f"k <= {SAMPLE_ROWS + CALIBRATION}")
    near = materialize(near.select("lang", "k", cut.alias("cut"), F.when(F.col("k") > SAMPLE_ROWS, F.col("text")).alias("text")), "labelled")
    first = near.where(f"k <= {SAMPLE_ROWS}").select("lang", "k", "cut").orderBy("lang", "k").collect()
    counts = {r["lang"]: r["count"] for r in labelled.where("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    cuts: dict[str, list[bytes]] = {}
    for r in first:
        cuts.setdefault(r["lang"], []).append(letters(r["cut"]))
    order = sorted((lang for lang, parts in cuts.items() if b"".join(parts).strip()), key=lambda x: (-counts[x], x))
    model = Model([(lang, b"".join(cuts[lang]).rjust(8)) for lang in order])
    tried = predict(near.where(f"k > {SAMPLE_ROWS}").repartition(spark.sparkContext.defaultParallelism), model, ["lang"]).collect()
    right = [r.score for r in tried if r.lang_pred == r["lang"]]
    return Model(model.dictionaries, max(MARGIN, min(right) * LEEWAY) if right and len(order) > 1 else MARGIN)


def decide(model: Model, compressors: list, text: str | None) -> tuple[str, float]:
    data = letters(text or "")
    if not compressors or not data.strip():
        return UNDECIDED, 0.0
    sizes = [0] * len(compressors)
    for at in range(0, len(data), BLOCK):
        block = PAD + data[at : at + BLOCK]
        for k, c in enumerate(compressors):
            sizes[k] += len(c.compress(block))
    ranked = sorted(range(len(sizes)), key=sizes.__getitem__)
    gap = 1 - sizes[ranked[0]] / sizes[ranked[1]] if len(ranked) > 1 else 1.0
    return model.dictionaries[ranked[0]][0], gap


def rejected(model: Model, lang: str, score: float) -> bool:
    return lang == UNDECIDED or score < model.margin


def ready(model: Model) -> list:
    """This worker's compressors of the model."""
    return hold(("language", model.key), model.compressors)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [decide(model, ready(model), t.as_py()) for t in batch.column(batch.num_columns - 1)]
            out = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([rejected(model, *g) for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` with lang_pred, score and rejected."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_judged"))
    out = schema(**{f.name: f.dataType for f in rows.schema[:-1]}, lang_pred=STRING, score=DOUBLE, rejected=T.BooleanType())
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), out)


def keeps(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't rejected; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def decided(texts: pa.Array) -> pa.Array:
        model = shared.value
        return pa.array([not rejected(model, *decide(model, ready(model), t.as_py())) for t in texts], pa.bool_())

    return docs.where(decided(F.col("text").cast("string")))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod(F.col("doc_id"), 4) != 2)


def op5_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs))
    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
