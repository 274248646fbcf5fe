"""Language ID: interpolated Kneser-Ney character models, one per language, in stored tables.

Texts are lower-cased, every run of other characters than letters becomes one boundary, and each character a 12-bit class
(its code point; those from 2048 on fold into the upper half). Five classes are one long, so suffixes and contexts are bit
operations. All learning texts are counted: workers count whole batches, Spark sums them, and the counts of lower orders are
continuation counts, numbers of different characters seen before. Per language and order the model is a stored table of all
n-grams with their discounted share and of all contexts with their back-off weight; none is left out.

Joins, order by order, give every different five of a table of texts its probability in each language. The commonest fives are
sent to the workers, which sum them; the others of a text are joined with the table of probabilities, so all count.

The prediction is the language with the lowest cross-entropy per character. It is rejected where that is above what the
language's own learning texts reach, see `calibrate`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, settle, stored
from .common import content_key, fold_part, free_names

ORDER, BITS = 5, 12
DISCOUNT = 0.75
#: Most probabilities (n-grams times languages) that are sent to the workers; the others are joined.
MOST_SENT = 1_000_000
SLOT_BITS = 21

_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point; 0 for what isn't a letter."""
    if not _CLASS:
        point = np.arange(0x110000)
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        _CLASS.append(np.where(letter, np.where(point < 2048, point, 2048 + point % 2048), 0).astype(np.uint16))
    return _CLASS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every character of the texts and at the boundary after each word; texts' first positions."""
    lowered = [x.lower() for x in texts]
    joined = "".join(x + "\n" for x in lowered)
    code = classes()[np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)]
    text = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in lowered])[: len(code)]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    if len(code):
        keep[0] = code[0] != 0
        keep[1:] &= (code[1:] != 0) | (text[1:] == text[:-1])  # the separator of two texts is no boundary of either
    code, text = code[keep].astype(np.int64), text[keep]
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    start = np.repeat(first[:-1], np.diff(first))
    place = np.arange(len(code)) - start
    whole = code.copy()
    for back in range(1, ORDER):
        shifted = np.zeros(len(code), dtype=np.int64)
        shifted[back:] = code[:-back] if back < len(code) else 0
        shifted[place < back] = 0
        whole |= shifted << (BITS * back)
    return whole, first


def batches_of_text(batch: pa.RecordBatch, column: int, limit: int = 1 << 20):
    """Rows of a batch in groups of about `limit` characters: (first row, texts)."""
    held, size, at = [], 0, 0
    for start in range(0, batch.num_rows, 128):
        for i, text in enumerate(batch.column(column).slice(start, 128).to_pylist(), start):
            held.append(text or "")
            size += len(text or "")
            if size >= limit:
                yield at, held
                held, size, at = [], 0, i + 1
    if held:
        yield at, held


def counted(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of `docs` (lang, text)."""

    def run(batches):
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (gram, n) in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])
            seen.clear()

        for batch in batches:
            for at, texts in batches_of_text(batch, 1):
                langs = np.array(batch.column(0).slice(at, len(texts)).to_pylist(), dtype=object)
                whole, first = grams(texts)
                owner = np.repeat(np.arange(len(texts)), np.diff(first))
                for lang in set(langs.tolist()):
                    gram, n = np.unique(whole[(langs == lang)[owner]], return_counts=True)
                    if lang in seen:
                        gram, back = np.unique(np.concatenate((seen[lang][0], gram)), return_inverse=True)
                        n = np.bincount(back, np.concatenate((seen[lang][1], n))).astype(np.int64)
                    seen[lang] = gram, n
                if sum(len(gram) for gram, _ in seen.values()) > 1 << 19:
                    yield from flush()
        yield from flush()
        pa.default_memory_pool().release_unused()

    rows = docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def suffix(level: int) -> Column:
    """The last `level` classes of `gram`."""
    return F.col("gram").bitwiseAND(F.lit((1 << (BITS * level)) - 1))


def leveled(grams: DataFrame, least: int, *columns: str) -> DataFrame:
    """`columns`, level, gram: the different suffixes of `grams` of `least` to ORDER - 1 classes, the level as a column."""
    parts = F.array(*[F.struct(F.lit(level).alias("level"), suffix(level).alias("gram")) for level in range(least, ORDER)])
    return grams.select(*columns, F.inline(parts)).distinct()


def entries(counts: DataFrame) -> DataFrame:
    """kind (0 n-gram, 1 context), level, lang, key, value: the interpolated models, all levels in one table.

    The value of an n-gram is max(n - d, 0) / n(context), that of a context is d * different followers / n(context). Below
    the highest level n is the number of different n-grams one class longer that end in it.
    """
    longest = counts.select("lang", F.lit(ORDER).alias("level"), "gram")
    longer = leveled(counts, 2, "lang").select("lang", "level", "gram").unionAll(longest)
    tail = F.expr(f"gram & (shiftleft(1L, {BITS} * (level - 1)) - 1L)")
    lower = longer.groupBy("lang", (F.col("level") - 1).alias("level"), tail.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    grams = stored(lower.unionAll(counts.select("lang", F.lit(ORDER).alias("level"), "gram", "n")))
    context = F.shiftright("gram", BITS)
    sums = stored(grams.groupBy("lang", "level", context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("followers")))
    of = sums.select(F.col("lang").alias("of_lang"), F.col("level").alias("of_level"), "context", "total")
    joined = grams.hint("merge").join(of, (F.col("lang") == F.col("of_lang")) & (F.col("level") == F.col("of_level")) & (context == F.col("context")))
    shares = joined.select(F.lit(0).alias("kind"), "level", "lang", F.col("gram").alias("key"), ((F.col("n") - DISCOUNT) / F.col("total")).cast("float").alias("value"))
    weights = sums.select(F.lit(1).alias("kind"), "level", "lang", F.col("context").alias("key"), (F.col("followers") * DISCOUNT / F.col("total")).cast("float").alias("value"))
    made = stored(shares.unionAll(weights))
    release(grams)
    release(sums)
    return made


def by_key(tables: DataFrame, langs: list[str]) -> DataFrame:
    """kind, level, key, own: the values of all languages side by side; 0 for an n-gram and 1 for a context that a language lacks."""
    known = tables.groupBy("kind", "level", "key").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.col("value").cast("double")))).alias("known"))
    names = F.array(*[F.lit(x) for x in langs])
    return known.select("kind", "level", "key", F.transform(names, lambda x: F.coalesce(F.try_element_at("known", x), F.col("kind").cast("double"))).alias("own"))


@dataclass
class Model:
    langs: list[str]
    #: kind, level, key, own as `by_key` makes them
    tables: DataFrame
    letters: int
    limit: list[float] = field(default_factory=list)
    sharpness: float = 1.0


def gram_values(grams: DataFrame, model: Model) -> DataFrame:
    """`grams` (gram, n) with value: natural log of the probability of the last character, an element per language.

    All levels of every n-gram get their shares and weights in two joins; then the levels back off into one another. Stored.
    """
    wanted = leveled(grams, 1).withColumn("n", F.lit(0).cast("long")).unionAll(grams.select(F.lit(ORDER).alias("level"), "gram", "n"))
    shares, weights = (model.tables.where(F.col("kind") == kind).select("level", "key", "own").toDF(*names) for kind, names in enumerate((("s_level", "s_key", "share"), ("w_level", "w_key", "weight"))))
    parts = stored(
        wanted.join(shares.hint("merge"), (F.col("level") == F.col("s_level")) & (F.col("gram") == F.col("s_key")), "left")
        .join(weights.hint("merge"), (F.col("level") == F.col("w_level")) & (F.shiftright("gram", BITS) == F.col("w_key")), "left")
        .select("level", "gram", "n", *[F.coalesce(name, F.array(*[F.lit(missing)] * len(model.langs))).alias(name) for name, missing in (("share", 0.0), ("weight", 1.0))])
    )
    lower = None
    for level in range(1, ORDER + 1):
        now = parts.where(F.col("level") == level)
        if lower is None:
            now = now.withColumn("before", F.array(*[F.lit(1.0 / model.letters)] * len(model.langs)))
        else:
            now = now.hint("merge").join(lower.toDF("l_gram", "before"), suffix(level - 1) == F.col("l_gram"))
        p = F.zip_with(F.zip_with("weight", "before", lambda x, y: x * y), "share", lambda x, y: x + y)
        lower = now.select("gram", *(["n"] if level == ORDER else []), p.alias("p"))
    out = stored(lower.select("gram", "n", F.transform("p", lambda x: F.log(x).cast("float")).alias("value")))
    release(parts)
    return out


def slots(whole: np.ndarray) -> np.ndarray:
    return ((whole.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Scorer:
    """Summed log likelihood of texts over n-grams sent along (sorted, with their values), and the other n-grams of each text."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        self.gram, self.value = gram, value
        self.keys = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        self.at = np.zeros(1 << SLOT_BITS, dtype=np.int32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Sums (a row a text, a column a language), the number of characters, and per text the other n-grams with their counts."""
        whole, first = grams(texts)
        n = np.diff(first)
        owner = np.repeat(np.arange(len(texts)), n)
        place = np.full(len(whole), -1, dtype=np.int64)
        if len(whole) and len(self.gram):
            slot = slots(whole)
            hit = self.keys[slot] == whole
            place[hit] = self.at[slot[hit]]
            if not hit.all():
                fresh, back = np.unique(whole[~hit], return_inverse=True)
                at = np.minimum(np.searchsorted(self.gram, fresh), len(self.gram) - 1)
                sent = self.gram[at] == fresh
                place[~hit] = np.where(sent, at, -1)[back]
                fresh, at = fresh[sent], at[sent]
                free, first_of = np.unique(slots(fresh), return_index=True)
                first_of = first_of[self.keys[free] == -1]  # the n-grams of texts seen first are the common ones, so they stay
                self.keys[slots(fresh[first_of])], self.at[slots(fresh[first_of])] = fresh[first_of], at[first_of]
        known = place >= 0
        out = np.stack([np.bincount(owner[known], self.value[place[known], i], len(texts)) for i in range(self.value.shape[1])], axis=1)
        rest, whose = whole[~known], owner[~known]
        bounds = np.searchsorted(whose, np.arange(len(texts) + 1))
        return out, n, [np.unique(rest[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]


def entropies(texts: DataFrame, model: Model) -> DataFrame:
    """digest, n, letters, entropy of every different text of `texts` (text): characters, whether it has a letter, and the
    cross-entropy per character in each language.

    An n-gram that isn't sent to the workers is rarer than all that are, so no key of the join is busy.
    """
    seen = counted(texts.select(F.lit("").alias("lang"), "text")).select("gram", "n")
    seen = stored(seen)
    values = gram_values(seen, model)
    release(seen)
    scale = F.length(F.bin("n"))
    least, held = 64, 0
    for row in values.groupBy(scale.alias("scale")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("scale")).collect():
        held += row["n"]
        if held * len(model.langs) > MOST_SENT:
            break
        least = row["scale"]
    common = values.where(scale >= least).select("gram", "value").toArrow()
    gram = common["gram"].to_numpy().astype(np.int64)
    value = np.array(common["value"].combine_chunks().flatten(), dtype=np.float32).reshape(len(gram), len(model.langs))
    order = np.argsort(gram)
    sent = texts.sparkSession.sparkContext.broadcast((gram[order], value[order]))

    def run(batches):
        scorer = Scorer(*sent.value)
        for batch in batches:
            for first, some in batches_of_text(batch, 1):
                sums, n, rest = scorer(some)
                letters = [any(map(str.isalpha, x)) for x in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(some)), pa.array(n), pa.array(letters), pa.array(sums.tolist(), pa.list_(pa.float64())),
                        pa.array([g for g, _ in rest], pa.list_(pa.int64())), pa.array([c for _, c in rest], pa.list_(pa.int64())),
                    ],
                    names=["digest", "n", "letters", "sums", "gram", "times"],
                )
        pa.default_memory_pool().release_unused()

    rows = texts.select(content_key("text", "text")[1], "text")
    made = stored(rows.mapInArrow(run, "digest binary, n bigint, letters boolean, sums array<double>, gram array<bigint>, times array<bigint>"))
    one = made.groupBy("digest").agg(*[F.first(x).alias(x) for x in ("n", "letters", "sums")])
    rest = made.select("digest", F.inline(F.arrays_zip("gram", "times"))).groupBy("digest", "gram").agg(F.first("times").alias("times"))
    more = (
        rest.hint("merge").join(values.select(F.col("gram").alias("of"), "value"), F.col("gram") == F.col("of")).groupBy(F.col("digest").alias("of_digest"))
        .agg(F.array(*[F.sum(F.col("times") * F.get("value", F.lit(i)).cast("double")) for i in range(len(model.langs))]).alias("more"))
    )
    total = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda x, y: x + y))
    entropy = F.transform(total, lambda x: -x / F.greatest("n", F.lit(1)))
    return stored(one.hint("merge").join(more, F.col("digest") == F.col("of_digest"), "left").select("digest", "n", "letters", entropy.alias("entropy")))


def models(learn: DataFrame) -> Model:
    """Models of all languages in `learn` (lang, text), not calibrated. Rows with null lang or text teach nothing.

    No rows give a model without languages, which predicts `und` everywhere.
    """
    counts = stored(counted(learn))
    made = entries(counts)
    release(counts)
    langs = sorted(row["lang"] for row in made.select("lang").distinct().collect())
    tables = stored(by_key(made, langs)) if langs else made
    if langs:
        release(made)
        settle(learn.sparkSession)
    letters = max(2, tables.where("kind = 0 AND level = 1").select("key").distinct().count() + 1)
    return Model(langs, tables, letters)


def fit(learn: DataFrame) -> Model:
    """models() of `learn`, calibrated."""
    model = models(learn)
    if model.langs:
        calibrate(model, learn, entropies(learn.where("lang IS NOT NULL AND text IS NOT NULL").select("text"), model))
    return model


def fit_part(docs: DataFrame) -> tuple[Model, DataFrame | None]:
    """The calibrated model of the rows of `docs` whose crc32 of the id, modulo 3, is not 1, and the entropies of all rows."""
    learn = docs.where(fold_part(F.col("doc_id"), 3) != 1)
    model = models(learn)
    if not model.langs:
        return model, None
    scores = entropies(docs.select("text"), model)
    calibrate(model, learn, scores)
    return model, scores


def calibrate(model: Model, learn: DataFrame, scores: DataFrame) -> None:
    """Sets the rejection limit of each language and the sharpness of scores from all learning rows, equal ones counted once.

    `scores` are entropies() of texts that hold those of `learn`. A text is rejected where its cross-entropy is above the
    highest of its language's rows plus half of its distance to a uniform guess. The sharpness makes the scores of the rows likeliest.
    Rows become sums and maxima in their tasks.
    """
    langs, steps = model.langs, [0.5 * 2**k for k in range(9)]
    model.limit = [math.log(model.letters)] * len(langs)
    rows = learn.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", content_key("text", "text")[1]).distinct()
    found = rows.hint("merge").join(scores.where("n > 0").withColumnRenamed("digest", "of"), F.col("digest") == F.col("of")).select("lang", "entropy")

    def run(batches):
        top, fit, n = {}, np.zeros(len(steps)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            entropy = np.array(batch.column(1).flatten()).reshape(batch.num_rows, len(langs))
            truth = np.array([langs.index(x) for x in batch.column(0).to_pylist()])
            n += len(truth)
            own, every = entropy.argmin(axis=1) == truth, np.arange(len(truth))
            for i in np.unique(truth[own]).tolist():
                top[i] = max(top.get(i, 0.0), float(entropy[own & (truth == i), i].max()))
            fit += [np.log(np.clip(posterior(entropy, x)[every, truth], 1e-9, 1)).sum() for x in steps]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*top, *range(-len(steps) - 1, 0)], pa.int32()), pa.array([*top.values(), n, *fit.tolist()], pa.float64())], names=["what", "value"]
        )

    parts = found.mapInArrow(run, "what int, value double")
    total = dict(parts.groupBy("what").agg(F.when(F.col("what") < 0, F.sum("value")).otherwise(F.max("value")).alias("value")).collect())
    for i in range(len(langs)):
        if i in total:
            model.limit[i] = total[i] + 0.5 * max(0.0, math.log(model.letters) - total[i])
    if total.get(-len(steps) - 1):
        # Sums of tasks are added in any order, so the last digits do not count.
        model.sharpness = max(steps, key=lambda x: round(total[steps.index(x) - len(steps)], 6))


def posterior(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    z = np.exp(-sharpness * (entropy - entropy.min(axis=1, keepdims=True)))
    return z / z.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "accepted"), scores: DataFrame | None = None) -> DataFrame:
    """`docs` with lang_pred, score and accepted, or as `names` call them; columns already named so are replaced.

    `scores` are entropies() of their texts, where they are known.

    lang_pred is `und` (score 0, not accepted) where the text is null or has no letter. Ties go to the first language by name.
    """
    kept = docs.drop(*names)
    if not model.langs:
        return kept.withColumns(dict(zip(names, (F.lit("und"), F.lit(0.0), F.lit(False)))))
    langs, limit, sharpness = model.langs, np.array(model.limit), model.sharpness

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            entropy = np.array(batch.column(2).flatten()).reshape(batch.num_rows, len(langs))
            letters = np.array(batch.column(1))
            best = entropy.argmin(axis=1)
            every = np.arange(len(best))
            sure = np.where(letters, posterior(entropy, sharpness)[every, best], 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([langs[i] if has else "und" for i, has in zip(best.tolist(), letters.tolist())]), pa.array(sure), pa.array(letters & (entropy[every, best] <= limit[best]))],
                names=["of_digest", "pred", "sure", "fits"],
            )

    known = entropies(kept.select(F.col(text).alias("text")), model) if scores is None else scores
    judged = known.select("digest", "letters", "entropy").mapInArrow(run, "of_digest binary, pred string, sure double, fits boolean")
    whole = kept.select(F.struct("*").alias("row"), content_key(text, text)[1])
    return whole.hint("merge").join(judged, F.col("digest") == F.col("of_digest")).select(
        *(F.col("row")[name].alias(name) for name in kept.columns), *(F.col(x).alias(name) for x, name in zip(("pred", "sure", "fits"), names))
    )


def only_accepted(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang and others) without the rows that are rejected; learnt as in split_predict."""
    names = tuple(free_names(docs.columns, "lang_pred", "score", "accepted"))
    model, scores = fit_part(docs)
    return predict(docs, model, names=names, scores=scores).where(F.col(names[2])).select(*docs.columns)


def split_predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of `docs` (doc_id, text, lang), learnt from the rows whose crc32 of the id, modulo 3, is not 1.

    A null id counts as empty text, so its rows are learnt from.
    """
    model, scores = fit_part(docs)
    found_langs = predict(docs.select("doc_id", "text"), model, scores=scores)
    return found_langs.select("doc_id", (fold_part(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")
