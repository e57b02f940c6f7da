"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become learned vectors; learned filters of WIDTH bytes slide over the whole text with a stride of STRIDE,
so neighbouring windows overlap and every byte is covered. Each filter's response is max-pooled over the text,
rectified, and a logistic layer combines the pooled responses into one probability.

The network is fitted by gradient descent on a bounded sample of labelled rows: `per_class` texts of each label at
most, in the order of a hash of doc_id among rows that aren't held out, and no more of them than FIT_BYTES bytes of
each label hold. Texts are fitted and scored whole, whatever their length, in pieces that overlap by one window.

Defined results: null or empty text scores as a text of WIDTH zero bytes; a null doc_id is scored and not held out;
repeated rows are each returned; an empty table gives an empty result; labels that are null or whose doc_id is null
or unknown teach nothing; with labels of one kind only, or none, every score is that label's share or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import ddl, texts

WIDTH, STRIDE, DIM, FILTERS = 8, 2, 8, 16
#: Most texts of each label in the sample that the network is fitted on.
PER_CLASS = 1500
#: Most bytes of each label's texts in the sample; texts in it are whole.
FIT_BYTES = 12 << 20
#: Bytes of a text that go through the filters at once.
PIECE = 1 << 16


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class ByteNet:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.constant: float | None = None

    def pooled(self, data: bytes, where: bool = False):
        """The largest response of each filter over all windows, and the windows where they are."""
        if len(data) < WIDTH:
            data = data + bytes(WIDTH - len(data))
        elif (len(data) - WIDTH) % STRIDE:
            data = data + bytes(STRIDE - (len(data) - WIDTH) % STRIDE)
        buf = np.frombuffer(data, np.uint8)
        best, at = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        for a in range(0, len(buf) - WIDTH + 1, PIECE):
            e = self.embed[buf[a : a + PIECE + WIDTH - STRIDE]].ravel()
            for phase in range(0, WIDTH, STRIDE):
                n = (len(e) // DIM - phase) // WIDTH
                if n > 0:
                    r = e[phase * DIM : (phase + n * WIDTH) * DIM].reshape(n, WIDTH * DIM) @ self.filters
                    if where:
                        i = r.argmax(axis=0)
                        top = r[i, np.arange(FILTERS)]
                        at = np.where(top > best, a + phase + i * WIDTH, at)
                        best = np.maximum(best, top)
                    else:
                        best = np.maximum(best, r.max(axis=0))
        return (best, at, buf) if where else best

    def probability(self, data: bytes) -> float:
        if self.constant is not None:
            return self.constant
        z = float(np.maximum(self.pooled(data) + self.bias, 0) @ self.out + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, rows: list[bytes], labels: list[int], epochs: int = 6, rate: float = 0.05, seed: int = 7) -> ByteNet:
        share = float(np.mean(labels)) if labels else 0.5
        if share in (0.0, 1.0) or not labels:
            self.constant = share
            return self
        rng = np.random.default_rng(seed)
        weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}  # both kinds count alike
        squares: dict[str, np.ndarray] = {}

        def step(name: str, grad):
            squares[name] = s = 0.9 * squares.get(name, np.zeros_like(grad)) + 0.1 * grad * grad
            setattr(self, name, (getattr(self, name) - now * grad / np.sqrt(s + 1e-6)).astype(np.float32))

        batch = 16
        for epoch in range(epochs):
            now, order = rate / (1 + 2 * epoch), rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                g = {k: np.zeros_like(getattr(self, k)) for k in ("embed", "filters", "bias", "out")}
                g_out_bias = np.float32(0)
                for i in order[a : a + batch]:
                    best, at, buf = self.pooled(rows[i], where=True)
                    h = np.maximum(best + self.bias, 0)
                    z = float(h @ self.out + self.out_bias)
                    d = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weight[labels[i]] / batch)
                    g["out"] += d * h
                    g_out_bias += d
                    back = np.where(best + self.bias > 0, d * self.out, 0).astype(np.float32)
                    g["bias"] += back
                    window = buf[at[:, None] + np.arange(WIDTH)]
                    g["filters"] += self.embed[window].reshape(FILTERS, -1).T * back
                    np.add.at(g["embed"], window, (self.filters * back).T.reshape(FILTERS, WIDTH, DIM))
                for k, v in g.items():
                    step(k, v)
                step("out_bias", g_out_bias)
        return self


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """The bounded sample: whole text and label of at most per_class rows and fit_bytes bytes of each label that aren't held out."""
    ranked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    ranked = ranked.groupBy("id").agg(F.min("label").alias("label"))
    picked = [ranked.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    wanted = picked[0].union(picked[1])
    wanted = wanted.withColumn("place", F.xxhash64("id"))
    # Of each label whole texts, in the order they were picked, as far as the bytes go.
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(wanted), F.col("doc_id") == F.col("id")).groupBy("label", "place", "id").agg(F.max("size").cast("long").alias("size"))
    upto = Window.partitionBy("label").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)  # per_class rows
    taken = sizes.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= fit_bytes).select("id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(taken), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.max_by("text", F.octet_length("text")).alias("text"), F.max("label").alias("label"))


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> ByteNet:
    sample = sorted((r["id"], r["text"].encode(), r["label"]) for r in training_rows(docs, labels, label_col, per_class).collect())
    return ByteNet().fit([t for _, t, _ in sample], [x for _, _, x in sample])


def scorer(net):
    def score(batches):
        model = net.value
        for batch in batches:
            rows = batch.column(1).cast(pa.binary())
            found = [model.probability(rows[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.float64()), *batch.columns[2:]], names=[*batch.schema.names[:2], "score", *batch.schema.names[2:]])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, score (0 to 1, higher: label 1 likelier), the columns named in carry and held_out for every row of docs."""
    docs = texts(docs, id_col, text_col, carry)
    net = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label_col, per_class))
    return docs.mapInArrow(scorer(net), "doc_id long, text string, score double" + ddl(docs, carry)).withColumn("held_out", held_out(F.col("doc_id")))
