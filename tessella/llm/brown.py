"""Language-model scores from Brown class bigrams.

Every word that the training texts have ``SEEN`` times or more has a class of its context, so that the
clustered vocabulary grows with the corpus, and the number of classes with its fourth root:

* the ``CORE`` commonest words are put into classes by the exchange algorithm, which moves one word at a
  time to the class that raises the likelihood of the class bigrams most;
* each further one goes to the class that raises it most to first order, by the classes of its neighbours,
  counted and compared in tasks.

Only rarer words, which have too few neighbours to tell, fall into classes by their last byte, and a text's end is
a class of its own. A token's probability is P(its class | the class before) * P(token | its class):

* transitions are interpolated with the class's own share, for a class never seen too;
* a listed word has its share of its class; another word c - D of its class, where D is the absolute
  discount n1 / (n1 + 2 n2) of the counts of counts; what is discounted is the share of unseen words.

Every count is taken over all training texts. Counts of rarer words stay distributed and meet the
texts in a join; the class and count of each listed word, and bigram tables of the core and of classes, go
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import Slice, mix64, owners, slices, word_hashes, words
from tessella.session import materialize

#: Words that are exchanged.
CORE = 2048
#: Occurrences that give a word a class of its context.
SEEN = 5
#: Classes of ``CORE`` words; more words have more.
CLASSES = 48
ENDINGS = 16
PASSES = 4
#: Weight of a class's own share in its transitions, as a number of observations.
PRIOR = 20.0
HELD = 1 << 22


@dataclass
class Model:
    """What scoring needs of the corpus besides the counts of unlisted words; it grows with the listed ones."""

    listed: np.ndarray  # sorted hashes
    group: np.ndarray  # class of each listed word, then of each ending, then of the end
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(word | class) of each listed word; of endings without the count; of the end
    base: np.ndarray  # log10 of the base probability of each listed word; last of the end
    unseen: np.ndarray  # log10 of the weight of an unseen word, for each ending
    discount: float
    tokens: int
    types: int
    texts: int


def token_indexes(part: Slice, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index, text, hash, place of the words) of all tokens of a slice; each text ends with an end."""
    found = words(part)
    hashes = word_hashes(part, found, lower=True)
    owner = owners(found)
    n = len(found.bounds) - 1
    last = part.data[found.ends - 1] if len(hashes) else np.zeros(0, np.uint8)
    kind = len(listed) + (np.where((last >= 65) & (last <= 90), last + 32, last) % ENDINGS).astype(np.int64)
    if len(listed) and len(hashes):
        at = np.searchsorted(listed, hashes)
        at[at == len(listed)] = 0
        kind = np.where(listed[at] == hashes, at, kind)
    index = np.full(len(hashes) + n, len(listed) + ENDINGS, np.int64)
    place = np.arange(len(hashes)) + owner
    index[place] = kind
    text = np.repeat(np.arange(n), np.diff(found.bounds) + 1)
    return index, text, hashes, place


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over texts (text); summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            word, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c)], ["word", "c"])

        for batch in batches:
            for part in slices(batch.column(0)):
                held.append(word_hashes(part, words(part), lower=True))
                n += len(held[-1])
                if n >= HELD:
                    yield out()
                    n = 0
        if held:
            yield out()

    return texts.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bigram_table(texts: DataFrame, listed: np.ndarray) -> np.ndarray:
    """Counts of adjacent tokens among listed words, endings and the end."""
    size = len(listed) + ENDINGS + 1
    spread = texts.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int32)
        for batch in batches:
            for part in slices(batch.column(0)):
                index = token_indexes(part, spread.value)[0]
                before = np.append(size - 1, index[:-1])
                pair, c = np.unique(before * size + index, return_counts=True)
                total[pair] += c.astype(np.int32)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair].astype(np.int64))], ["pair", "c"])

    rows = texts.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    table = np.zeros(size * size, np.float64)
    table[rows.column("pair").to_numpy()] = rows.column("c").to_numpy()
    return table.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(table: np.ndarray, n: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each token kind. The first ``n`` move; each further kind keeps a class of its own.

    The words are taken by falling frequency; the first pass starts from their rank modulo ``classes``.
    """
    classes = max(1, min(classes, n)) if n else 0
    size = len(table)
    order = np.argsort(-table[:n].sum(axis=1), kind="stable")
    group = np.zeros(size, np.int64)
    group[order] = np.arange(n) % max(classes, 1)
    group[n:] = classes + np.arange(size - n)
    k = classes + size - n
    one = np.zeros((size, k))
    one[np.arange(size), group] = 1
    g = one.T @ table @ one
    for _ in range(passes):
        moved = 0
        for w in order:
            out = np.bincount(group, table[w], k)
            into = np.bincount(group, table[:, w], k)
            own = table[w, w]
            a = group[w]
            out[a] -= own
            into[a] -= own
            g[a, :] -= out
            g[:, a] -= into
            g[a, a] -= own
            # what each class would gain with the word in it
            rows, cols, diagonal = g[:classes], g[:, :classes].T, np.diag(g)[:classes]
            inside = np.arange(classes)
            gain = (_f(rows + out) - _f(rows)).sum(axis=1) + (_f(cols + into) - _f(cols)).sum(axis=1)
            gain -= _f(diagonal + out[inside]) + _f(diagonal + into[inside]) - 2 * _f(diagonal)
            gain += _f(diagonal + out[inside] + into[inside] + own) - _f(diagonal)
            left, right = g.sum(axis=1)[:classes], g.sum(axis=0)[:classes]
            gain -= _f(left + out.sum() + own) - _f(left) + _f(right + into.sum() + own) - _f(right)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            group[w] = b
            g[b, :] += out
            g[:, b] += into
            g[b, b] += own
        if not moved:
            break
    return group


def context_classes(texts: DataFrame, core: np.ndarray, group: np.ndarray, g: np.ndarray, listed: np.ndarray, classes: int) -> np.ndarray:
    """Class, below ``classes``, of each of the ``listed`` words that are not in the core.

    A word's counts of classes before and after it are summed over all texts; its class is the one where adding them
    raises the likelihood of the class bigrams ``g`` most, to first order.
    """
    k = len(g)
    share = (g.sum(axis=0) + 0.5) / (g.sum() + 0.5 * k)
    after = np.log((g + PRIOR * share) / (g.sum(axis=1, keepdims=True) + PRIOR))[:classes]
    share = (g.sum(axis=1) + 0.5) / (g.sum() + 0.5 * k)
    before = np.log((g.T + PRIOR * share) / (g.sum(axis=0)[:, None] + PRIOR))[:classes]
    sc = texts.sparkSession.sparkContext
    spread = sc.broadcast((core, group, listed, np.concatenate([before, after], 1).T))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, group, listed, _ = spread.value
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            key, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key // (2 * k)), pa.array(key % (2 * k)), pa.array(c)], ["at", "slot", "c"])

        for batch in batches:
            for part in slices(batch.column(0)):
                index, _, hashes, place = token_indexes(part, core)
                cls = group[index]
                at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
                new = np.flatnonzero((listed[at] == hashes) & (index[place] >= len(core)))
                at, where = at[new], place[new]
                # the end of its text, if nothing else, comes after each word
                left = np.where(where > 0, cls[where - 1], group[-1])
                held += [at * (2 * k) + left, at * (2 * k) + k + cls[where + 1]]
                n += 2 * len(at)
                if n >= HELD:
                    yield out()
                    n = 0
        if held:
            yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = spread.value[3]

        def best(at: np.ndarray, slot: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            total = np.add.reduceat(gain[slot] * c[:, None], first, axis=0)
            return pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(total.argmax(axis=1))], ["at", "class"])

        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            at, slot, c = (np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest))
            cut = int(np.searchsorted(at, at[-1])) if len(at) else 0  # the last word may go on
            if cut:
                yield best(at[:cut], slot[:cut], c[:cut])
            rest = [at[cut:], slot[cut:], c[cut:]]
        if len(rest[0]):
            yield best(*rest)

    counted = texts.mapInArrow(count, "at long, slot long, c long").groupBy("at", "slot").agg(F.sum("c").alias("c"))
    rows = counted.repartition("at").sortWithinPartitions("at").mapInArrow(choose, "at long, class long").toArrow()
    out = np.full(len(listed), -1, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("class").to_numpy()
    return out


def class_bigrams(texts: DataFrame, listed: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Counts of the classes of adjacent tokens."""
    spread = texts.sparkSession.sparkContext.broadcast((listed, group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, group = spread.value
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                cls = group[token_indexes(part, listed)[0]]
                total += np.bincount(np.append(group[-1], cls[:-1]) * k + cls, minlength=k * k)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "c"])

    rows = texts.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    table = np.zeros(k * k)
    table[rows.column("pair").to_numpy()] = rows.column("c").to_numpy()
    return table.reshape(k, k)


def fit(texts: DataFrame, counts: DataFrame, core_words: int = CORE) -> Model:
    """The model of training texts (text) with their word counts (word, c)."""
    top = counts.orderBy(F.desc("c"), "word").limit(core_words).toArrow()
    core = np.sort(top.column("word").to_numpy().astype(np.int64).view(np.uint64))
    often = counts.where(F.col("c") >= SEEN).toArrow()
    words_, c = (np.concatenate([t.column(i).to_numpy() for t in (top, often)]).astype(np.int64) for i in ("word", "c"))
    listed, first = np.unique(words_.view(np.uint64), return_index=True)
    c = c[first].astype(np.float64)
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    n_texts = texts.count()
    tokens, types = int(row[0]) + n_texts, int(row[1]) + (n_texts > 0)
    ones, twos = row[2] or 0, row[3] or 0
    discount = ones / (ones + 2 * twos) if ones else 0.5
    discount = min(max(discount, 0.1), 0.9)
    table = bigram_table(texts, core)
    wanted = round(CLASSES * max(1.0, len(listed) / CORE) ** 0.25)
    of_core = exchange(table, len(core), wanted)
    k = int(of_core.max()) + 1
    if len(listed) > len(core):
        one = np.zeros((len(table), k))
        one[np.arange(len(table)), of_core] = 1
        of_listed = context_classes(texts, core, of_core, one.T @ table @ one, listed, k - ENDINGS - 1)
    else:
        of_listed = np.zeros(len(listed), np.int64)
    of_listed[np.searchsorted(listed, core)] = of_core[: len(core)]
    group = np.concatenate([of_listed, of_core[len(core) :]])
    g = class_bigrams(texts, listed, group, k)
    size = len(group)
    share = (g.sum(axis=0) + 0.5) / (g.sum() + 0.5 * k)
    transition = np.log10((g + PRIOR * share) / (g.sum(axis=1, keepdims=True) + PRIOR))
    # Of a word's count, all of a listed class goes to its words; of an ending, the discount goes to unseen ones.
    occurs = g.sum(axis=0)
    in_class = np.maximum(occurs[group], 1)
    emission = np.zeros(size)
    emission[: len(listed)] = np.log10(np.maximum(c, 1)) - np.log10(in_class[: len(listed)])
    emission[len(listed) : -1] = -np.log10(in_class[len(listed) : -1])
    bottom = np.log10(tokens + 0.5 * (types + 1))
    base = np.log10(np.append(c, n_texts) + 0.5) - bottom
    # Types of an ending are taken in proportion to its tokens: their number scales the unseen share alone.
    rest = occurs[group[len(listed) : -1]]
    kinds = max(types - (n_texts > 0) - len(listed), 0) * rest / max(rest.sum(), 1)
    unseen = np.log10(np.where(rest > 0, np.clip(discount * kinds, 1e-3, np.maximum(rest, 1e-3)), 1.0))
    return Model(listed, group, transition, emission, base, unseen, float(discount), tokens, types, n_texts)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, core_words: int = CORE) -> DataFrame:
    """Scores of all documents by a model of those that ``held_out`` (a condition) leaves.

    Returns the id, held_out, n_tokens, n_known, train_tokens, base_score (an additive unigram) and
    score (log10 probability of the text). Null and empty texts are one end each. A null condition
    counts as false. Repeated rows count and are scored one by one; no training text at all leaves every
    word unseen.
    """
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    train = base.where(~F.col("held")).select("text")
    counts = materialize(word_counts(train))
    model = fit(train, counts, core_words)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = spread.value
        n_listed, end = len(m.listed), len(m.group) - 1
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch.column(2)):
                index, text, hashes, place = token_indexes(part, m.listed)
                n = part.last - part.first
                cls = m.group[index]
                before = np.append(m.group[end], cls[:-1])
                ready = m.transition[before, cls] + m.emission[index]
                known = (index < n_listed) | ((index == end) & (m.texts > 0))
                at_base = np.where(index == end, n_listed, np.minimum(index, max(n_listed - 1, 0)))
                easy = np.where((index < n_listed) | (index == end), m.base[at_base], 0.0)
                ids = np.arange(row, row + n)
                doc = [
                    pa.array(ids), batch.column(0).slice(part.first, n), batch.column(1).slice(part.first, n),
                    pa.array(mix64(ids.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)),
                    pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text, known, n).astype(np.int64)),
                    pa.array(np.bincount(text, easy, n)), pa.array(np.bincount(text, ready, n)),
                ]
                names = ["row", "id", "held", "word", "times", "ending", "n_tokens", "n_known", "base", "score"]
                yield pa.RecordBatch.from_arrays(doc, names)
                rest = np.flatnonzero(index[place] >= n_listed)
                if len(rest):
                    h, t, e = hashes[rest], text[place[rest]], index[place[rest]] - n_listed
                    order = np.lexsort((h, t))
                    h, t, e = h[order], t[order], e[order]
                    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
                    times = np.diff(np.append(first, len(h)))
                    k = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[t[first]]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.array(h[first].view(np.int64)),
                            pa.array(times.astype(np.int32)), pa.array(e[first].astype(np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                            pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()),
                        ],
                        names,
                    )
                row += n

    rows = base.mapInArrow(
        run, "row long, id long, held boolean, word long, times int, ending int, n_tokens long, n_known long, base double, score double"
    )
    joined = rows.join(counts.hint("shuffle_hash"), "word", "left")
    bottom = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    unseen = F.element_at(F.array(*[F.lit(float(x)) for x in model.unseen]), F.col("ending") + 1)
    c = F.coalesce("c", F.lit(0))
    seen = F.when(c > 0, F.log10(c - model.discount)).otherwise(unseen)
    out = joined.groupBy("row").agg(
        F.max("id").alias("id"), F.max("held").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(c > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(F.col("times") * (F.log10(c + 0.5) - bottom))).alias("base_score"),
        (F.max("score") + F.sum(F.col("times") * seen)).alias("score"),
    )
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
