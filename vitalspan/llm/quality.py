"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is compressed with both, piece
by piece and without what empty frames take. The difference bad - good of the two total sizes adds up over a text as its
evidence does, while chance adds up as the root of the length only: (bad - good) / sqrt(length + 1) is the normalised
difference, and nothing else is scored. A logistic curve fitted to labelled texts that the dictionaries didn't see turns
it into the probability of label 1. Sampled rows weigh as many as they stand for, so scores are calibrated to all
labelled rows.

Only texts are inputs. What is fitted comes from a bounded sample: SAMPLE labelled rows of each class in order of a hash
of their ids, and of the half of them that trains dictionaries PIECES pieces of each class in order of a hash, from
anywhere in their whole texts. All rows are scored, and whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import logistic, pieces, stored

#: Labelled rows of each class; pieces of each class that a dictionary is trained on, of as many code points each.
SAMPLE, PIECES, PIECE_CHARS = 3000, 7000, 600
#: Bytes of a dictionary and of a piece in scoring.
DICTIONARY, PIECE, LEVEL = 128 << 10, 2000, 3


@dataclass(frozen=True)
class Model:
    """Slope and offset of the logistic curve; no dictionaries: nothing was learnt, and the offset alone is the score."""

    good: bytes | None
    bad: bytes | None
    slope: float = 0.0
    offset: float = 0.0


def held_out(doc: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.crc32(doc.cast("string")) % 4 == 2, F.lit(False))


def _dictionary(pieces: list[str]) -> bytes:
    encoded = [t.encode() for t in pieces]
    try:
        return zstandard.train_dictionary(DICTIONARY, encoded).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: they are the dictionary themselves
        return b"\n".join(encoded)[-DICTIONARY:]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.good is not None:
            options = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.good, self.bad = (zstandard.ZstdCompressor(compression_params=options, dict_data=zstandard.ZstdCompressionDict(d)) for d in (model.good, model.bad))

            self.empty = len(self.good.compress(b"")) - 1, len(self.bad.compress(b"")) - 1

    def evidence(self, text: str) -> float:
        """The normalised difference."""
        data = text.encode()
        difference = 0
        for i in range(0, max(1, len(data)), PIECE):
            piece = data[i : i + PIECE]
            difference += len(self.bad.compress(piece)) - self.empty[1] - len(self.good.compress(piece)) + self.empty[0]
        return difference / math.sqrt(len(data) + 1)

    def score(self, text: str) -> float:
        x = self.model.offset
        if self.model.good is not None:
            x += self.model.slope * self.evidence(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from labelled rows outside the held-out fold.

    Labels other than 0 and 1, null texts and null ids are left out, and so are ids whose labels contradict each other. Of
    rows of docs that share an id the smallest text counts. If one of the classes has no rows, nothing is learnt and every
    score is the share of label 1 (0.5 without any). The driver gets PIECES pieces and SAMPLE numbers of each class, no texts."""
    rows = labels.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    usable = rows.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    order = F.xxhash64(F.lit("sample"), "id")
    chosen = usable.filter("y = 1").orderBy(order, "id").limit(SAMPLE).unionByName(usable.filter("y = 0").orderBy(order, "id").limit(SAMPLE))
    # 2 * SAMPLE rows at most, so the texts are found without a shuffle of the documents.
    found = docs.select(F.col(doc).alias("id"), F.col(text).alias("t")).filter("t IS NOT NULL").join(F.broadcast(chosen), "id")
    # Half of the rows make the dictionaries, the others the curve.
    sample = stored(found.groupBy("id", "y").agg(F.min("t").alias("t")).withColumn("trains", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)) == 0), "labelled")
    counts = {(r["y"], r["trains"]): r["count"] for r in sample.groupBy("y", "trains").count().collect()}
    many = [counts.get((y, True), 0) + counts.get((y, False), 0) for y in (0, 1)]
    if not min(many):
        share = many[1] / sum(many) if sum(many) else 0.5
        return Model(None, None, offset=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if min(counts.get((y, half), 0) for y in (0, 1) for half in (True, False)) < 1:  # with few rows both halves do both
        sample = sample.withColumn("trains", F.lit(None).cast("boolean"))
    trains, tests = F.coalesce("trains", F.lit(True)), ~F.coalesce("trains", F.lit(False))
    cut = sample.filter(trains).select("id", "y", F.posexplode(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))).alias("at", "piece"))
    place = F.xxhash64(F.lit("piece"), "id", "at")
    pieces = [[r["piece"] for r in cut.filter(F.col("y") == y).orderBy(place, "id", "at").limit(PIECES).collect()] for y in (0, 1)]
    scorer = Model(_dictionary(pieces[1]), _dictionary(pieces[0]))
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.evidence(t.as_py()) for t in batch.column(2)], pa.float64())], names=["id", "y", "x"])

    seen = sorted(sample.filter(tests).select(F.xxhash64("id").alias("id"), "y", "t").mapInArrow(measure, "id long, y int, x double").collect())
    x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float)
    totals = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    stand_for = np.array([totals[k] / max(1, (y == k).sum()) for k in (0, 1)])
    scale = len(x) / sum(totals.values())  # as if there were as many rows as were sampled
    slopes, offset = logistic(x[:, None], y, stand_for[y.astype(int)] * scale)
    return Model(scorer.good, scorer.bad, slopes[0], offset)


def quality_scores(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on). No shuffle.

    Null texts count as empty, and empty ones get the score of an even difference. Rows are independent of each other, so
    repeated rows get equal scores; very long texts are compressed whole, piece by piece. Columns called score or
    predicted, in whatever case, give way to the new ones; an empty table gives no rows."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        at = kept.index(text)
        scores = lambda texts: pa.array([scorer.score(t.as_py() or "") for t in texts], pa.float64())
        yield from pieces(batches, lambda b: pa.RecordBatch.from_arrays([*b.columns, scores(b.column(at))], names=[*kept, "score"]))

    scored = docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
