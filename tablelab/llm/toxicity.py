"""Toxicity: a chain of linear classifiers.

The categories are predicted one after another. Each is a logistic regression on
the words of a text (whole words and their first four and five bytes, hashed to
slots, present or not), and on the log-odds of the categories before it. While a
category is fitted, these come from models that have not seen the row (out of
fold), so that a later model learns how far to trust an earlier one.

Fitting reads at most ``fit_rows`` labelled documents without null marks, the
first by hashes of id and text. Slots are counted on executors; per category the ``SLOTS`` slots with the
largest chi-square are kept. One task gets, for each fitted row, the kept slots it holds, and fits the chain; the driver sees
the numbers of the kept slots and the weights. Scoring is one pass over all whole
texts. The limit of a category is the probability that gives the best F1 out of
fold.

Defined cases: rows with a null label in any category are not fitted; null and
empty texts have no words and get the model's base rate; repeated rows count and
are scored each time; without labelled rows, or with one class only, a category
has its smoothed base rate and rejects nothing; an empty table gives an empty
result; other columns are ignored when scoring and kept when filtering.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablelab.llm import kernels
from tablelab.session import materialise

FIT_ROWS, FOLDS = 20_000, 3
SLOTS_LOG, SLOTS = 20, 1024
PREFIXES = (4, 5)
RIDGE = 1.0
SLICE = 1 << 20  # bytes of text that are taken apart at once; a byte takes some forty in numbers


def _slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word feature of a column of lower-case texts."""
    data, at = kernels.byte_rows(column)
    hashes, starts, rows = kernels.words(data, at, kernels.MARKS)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    sizes = kernels.word_sizes(data, starts, kernels.MARKS, at)
    text, values, owners = kernels.eights(data), [hashes], [row]
    for k in PREFIXES:
        long = sizes >= k
        head = text[starts[long]] & np.uint64((1 << 8 * k) - 1)
        values.append(kernels.mix(head * kernels.numbers(51 + k, 1)[0]))
        owners.append(row[long])
    return np.concatenate(owners), (np.concatenate(values) >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)


def _present(row: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * width + slot)
    return both // width, both % width


def logistic(rows: np.ndarray, columns: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Ridge logistic regression by Newton steps with conjugate gradients. ``extra`` columns come first, the first of them is 1."""
    n, e = extra.shape
    pos = float(y.sum())
    w = np.zeros(e + width)
    w[0] = np.log((pos + 0.5) / (n - pos + 0.5))
    if not 0 < pos < n:
        return w
    ridge = np.full(e + width, RIDGE)
    ridge[0] = 1e-6

    def times(v: np.ndarray) -> np.ndarray:
        return extra @ v[:e] + np.bincount(rows, v[e:][columns], minlength=n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([extra.T @ r, np.bincount(columns, r[rows], minlength=width)])

    def loss(v: np.ndarray) -> float:
        z = times(v)
        return float(np.logaddexp(0, z).sum() - z @ y + 0.5 * (ridge * v * v).sum())

    now = loss(w)
    for _ in range(15):
        p = 1 / (1 + np.exp(-times(w)))
        gradient = back(p - y) + ridge * w
        if np.abs(gradient).max() < 1e-6 * n:
            break
        curve = p * (1 - p)
        scale = 1 / (back(curve) + ridge)
        step, r = np.zeros_like(w), -gradient
        z = scale * r
        d, rz = z.copy(), float(r @ z)
        for _ in range(20):
            hd = back(curve * times(d)) + ridge * d
            a = rz / float(d @ hd)
            step += a * d
            r -= a * hd
            if np.linalg.norm(r) < 0.03 * np.linalg.norm(gradient):
                break
            z = scale * r
            rz, before = float(r @ z), rz
            d = z + (rz / before) * d
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-4 * before:
            break
    return w


def _margin(rows: np.ndarray, columns: np.ndarray, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    e = extra.shape[1]
    return np.clip(extra @ w[:e] + np.bincount(rows, w[e:][columns], minlength=len(extra)), -30, 30)


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which F1 is best, half way between two that occur. Without both classes: never reached."""
    if not 0 < y.sum() < len(y):
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    p = p[order]
    f1[:-1][p[:-1] == p[1:]] = -1
    best = int(f1.argmax())
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)


class Chain:
    """The kept slots and the fitted models; some tens of KB, slots are looked up in a table that each worker makes for itself."""

    def __init__(self, categories: Sequence[str], kept: np.ndarray) -> None:
        self.categories, self.kept = list(categories), kept
        self.width = max(1, len(kept))
        self.weights: list[np.ndarray] = []
        self.limits: list[float] = []
        self._place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_place": None}

    def found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._place is None:
            self._place = np.full(1 << SLOTS_LOG, -1, np.int32)
            self._place[self.kept] = np.arange(len(self.kept))
        row, slot = _slots(column)
        place = self._place[slot]
        return _present(row[place >= 0], place[place >= 0].astype(np.int64), self.width)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        rows, columns = self.found(column)
        extra = np.ones((len(column), 1))
        for w in self.weights:
            extra = np.concatenate([extra, _margin(rows, columns, extra, w)[:, None]], axis=1)
        return 1 / (1 + np.exp(-extra[:, 1:]))


def _slot_counts(sample: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``slot``, the rows of each category's positives that hold it and, last, the rows of all."""
    c = len(categories)
    names = ["slot", *[f"n{i}" for i in range(c + 1)]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c + 1, 1 << SLOTS_LOG), np.int32)
        for batch in batches:
            for part in kernels.slices(batch, 0, SLICE):
                row, slot = _present(*_slots(part.column(0)), 1 << SLOTS_LOG)
                for i in range(c):
                    own = part.column(i + 1).to_numpy(zero_copy_only=False)[row] == 1
                    np.add.at(total[i], slot[own], 1)
                np.add.at(total[c], slot, 1)
        held = np.flatnonzero(total[c])
        for at in range(0, len(held), 1 << 16):
            part = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(t[part].astype(np.int64)) for t in total]], names=names)

    rows = sample.mapInArrow(count, ", ".join(f"{n} long" for n in names))
    return rows.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names[1:]])


def _kept_slots(sample: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Per category the slots with the largest chi-square, all together."""
    counts = materialise(_slot_counts(sample, names), "slots")
    *positives, rows = sample.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names], F.count("*")).first()
    here, kept = F.col(f"n{len(names)}"), set()
    for i, pos in enumerate(positives):
        expected = here * F.lit(pos / max(rows, 1))
        spread = F.greatest(expected * (1 - here / F.lit(max(rows, 1))), F.lit(1e-9))
        chi = F.when(here > 1, (F.col(f"n{i}") - expected) * (F.col(f"n{i}") - expected) / spread).otherwise(0.0)
        top = counts.select("slot", chi.alias("chi")).filter("chi > 30").orderBy(F.desc("chi"), "slot").limit(SLOTS)  # by chance: one slot in 20 million
        kept |= {r.slot for r in top.collect()}
    return np.array(sorted(kept), np.int64)


def _fit(table: pa.Table, names: Sequence[str], width: int, folds: int) -> tuple[list[np.ndarray], list[float]]:
    """Weights and limits of all categories, from the kept slots and marks of the fitted rows."""
    h = table.column("h").to_numpy()
    order = np.argsort(h, kind="stable")  # rows that share a hash are copies
    table, h = table.take(pa.array(order)), h[order]
    held = table.column("held").combine_chunks()
    rows = np.repeat(np.arange(len(h)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
    columns = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    fold = h % folds  # copies share a hash, and so a fold
    extra, weights, limits = np.ones((len(h), 1)), [], []
    for n in names:
        y = table.column(n).to_numpy().astype(float)
        margin = np.zeros(len(h))
        for f in range(folds):
            to, of = fold != f, fold == f
            renumbered = np.cumsum(to) - 1
            inside = to[rows]
            w = logistic(renumbered[rows[inside]], columns[inside], extra[to], y[to], width)
            margin[of] = _margin(rows, columns, extra, w)[of]
        weights.append(logistic(rows, columns, extra, y, width))
        limits.append(best_limit(1 / (1 + np.exp(-margin)), y))
        extra = np.concatenate([extra, margin[:, None]], axis=1)
    return weights, limits


def fit_chain(
    labelled: DataFrame, categories: Sequence[str], id: str = "doc_id", text: str = "text", folds: int = FOLDS
) -> Chain:
    """A chain for the 0/1 columns ``categories``, in their order, from all rows of ``labelled``: see ``labelled_sample``."""
    names = [f"c{i}" for i in range(len(categories))]
    sample = labelled.select(
        F.lower(F.col(text).cast("string")).alias("text"), *[F.col(c).cast("int").alias(n) for c, n in zip(categories, names)],
        F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("h"),
    ).na.drop(subset=names)
    sample = materialise(sample, "labelled")
    chain = Chain(categories, _kept_slots(sample, names))
    shared = labelled.sparkSession.sparkContext.broadcast(chain)
    width, columns = chain.width, ["held", *names, "h"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, 0, SLICE):
                rows, slots = shared.value.found(part.column(0))
                at = np.searchsorted(rows, np.arange(part.num_rows + 1))
                held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(slots, pa.int32()))
                yield pa.RecordBatch.from_arrays([held, *part.columns[1:]], names=columns)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            weights, limits = _fit(pa.Table.from_batches(parts), names, width, folds)
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist() for w in weights]), pa.array(limits)], names=["weights", "threshold"])

    schema = ", ".join(["held array<int>", *[f"{n} int" for n in names], "h long"])
    # One task: it holds the fitted rows' kept slots, at most ``fit_rows`` times ``width`` numbers.
    fitted = sample.mapInArrow(features, schema).repartition(1).mapInArrow(fit, "weights array<double>, threshold double").collect()
    for row in fitted:
        chain.weights.append(np.array(row.weights))
        chain.limits.append(row.threshold)
    for _ in categories[len(fitted) :]:  # no labelled rows
        chain.weights.append(np.zeros(len(chain.weights) + 1 + width))
        chain.limits.append(2.0)
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Documents with labels, at most ``fit_rows`` rows: the first by hashes of id and text. Label rows with a null are left out.

    Each label row kept has a document, so ``fit_rows`` of them hold enough rows. That bound lets them be broadcast.
    """
    ids = docs.select(id).distinct()
    chosen = labels.na.drop().join(ids, id, "left_semi").orderBy(F.xxhash64(id), id, *[c for c in labels.columns if c != id]).limit(fit_rows)
    chosen = materialise(chosen, "labels")
    if docs.select(id).join(F.broadcast(chosen), id).limit(fit_rows + 1).count() <= fit_rows:
        return docs.join(F.broadcast(chosen), id)
    marks = [c for c in labels.columns if c != id]
    first = docs.join(F.broadcast(chosen), id).orderBy(F.xxhash64(id), id, F.xxhash64(text), text, *marks).limit(fit_rows)
    return first.repartition(docs.sparkSession.sparkContext.defaultParallelism)


def score(docs: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, a probability ``p_<category>`` and a decision ``is_<category>`` for each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(id).alias("id"), F.lower(F.col(text).cast("string")).alias("text"))
    names = ["id", *[f"p_{c}" for c in chain.categories], *[f"is_{c}" for c in chain.categories]]
    kinds = [rows.schema["id"].dataType.simpleString(), *["double"] * len(chain.categories), *["boolean"] * len(chain.categories)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, 1, SLICE):
                p = shared.value.probabilities(part.column(1))
                decided = p > np.array(shared.value.limits)
                columns = [part.column(0), *[pa.array(c) for c in p.T], *[pa.array(c) for c in decided.T]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(apply, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))).withColumnRenamed("id", id)


def drop_rejected(docs: DataFrame, chain: Chain, category: str, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the chain does not put into ``category``."""
    shared, which = docs.sparkSession.sparkContext.broadcast(chain), chain.categories.index(category)

    @F.arrow_udf("boolean")
    def stays(texts: pa.Array) -> pa.Array:
        kept = [np.empty(0, bool)]
        for part in kernels.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, SLICE):
            kept.append(shared.value.probabilities(part.column(0))[:, which] <= shared.value.limits[which])
        return pa.array(np.concatenate(kept))

    return docs.filter(stays(F.lower(F.col(text).cast("string"))))
