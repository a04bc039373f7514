"""Language identification with interpolated Kneser-Ney character models.

For each language the n-grams of 1 to ``ORDER`` letters of its training texts are
counted, and interpolated Kneser-Ney probabilities are worked out for every n-gram
seen.  The models lie in one array of sorted n-gram hashes for each order, with a
column of log probabilities (and one of back-off weights) for each language, so that
one look-up serves all languages; an n-gram that no language has seen backs off.  The
language with the lowest cross-entropy per character is chosen; it is accepted if that
cross-entropy is below the language's threshold, a quantile of what texts of the
language have that were held back from the counts.

Training takes about ``TRAIN_DOCS`` whole texts of each language, and ``HELD_DOCS`` for the
thresholds, chosen by a hash of their id; every whole text is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SortedIndex, materialise

ORDER = 4
TRAIN_DOCS, HELD_DOCS = 1_000, 250
#: Languages that a model holds at most.
MAX_LANGUAGES = 200
DISCOUNT = 0.75
#: Share of a language's texts whose cross-entropy is accepted.
ACCEPTED = 0.995
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letter_table() -> np.ndarray:
    """For each code point of the basic plane: itself lower-cased if a letter, else a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


LETTER = _letter_table()


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one space between words, and where each text begins (one more than texts).

    Every text starts with a space; whatever is no letter separates words.  Characters
    beyond the basic plane count as separators unless they are letters.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer(" ".join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum(np.r_[0, sizes + 1])
    if len(code) == 0:
        return np.zeros(0, np.uint32), begins
    wide = np.flatnonzero(code >= 1 << 16)
    plain = LETTER[np.minimum(code, 65535)]
    for i in wide:
        plain[i] = code[i] if chr(code[i]).isalpha() else 32
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    keep[begins[:-1]] = True
    return plain[keep], np.r_[0, np.cumsum(keep)][begins]


def gram_hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each character, for n from 1 to ``order`` (it may reach into the text before)."""
    out, h = [], np.zeros(len(chars), np.uint64)
    x = chars.astype(np.uint64)
    with np.errstate(over="ignore"):
        power = np.uint64(1)
        for n in range(order):
            shifted = np.full(len(x), np.uint64(32))
            shifted[n:] = x[: len(x) - n]
            h = h + shifted * power
            power = power * _MIX
            out.append(h * _MIX ^ (h >> np.uint64(29)))
    return out


def _reach(begins: np.ndarray, n: int) -> np.ndarray:
    """Place of each character within its text."""
    sizes = np.diff(begins)
    return np.arange(n) - np.repeat(begins[:-1], sizes)


@dataclass
class Level:
    """Sorted hashes of one order; log10 probability and log10 back-off weight (of the n-gram as context) by language."""

    index: SortedIndex
    logp: np.ndarray
    back: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return self.index.keys

    def find(self, h: np.ndarray) -> np.ndarray:
        return self.index.find(h)


@dataclass
class LanguageModel:
    languages: list[str]
    levels: list[Level]
    unseen: np.ndarray  # log10 probability of a character never seen, by language
    limit: np.ndarray  # highest accepted cross-entropy, by language

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and the number of letters."""
        chars, begins = characters(texts)
        n, k = len(chars), len(self.languages)
        place = _reach(begins, n)
        hashes = gram_hashes(chars, len(self.levels))
        logp = np.zeros((n, k), np.float32)
        todo = np.arange(n)[place > 0]  # the leading space of a text is context only
        top = len(self.levels)
        waiting = np.minimum(place[todo] + 1, top)
        for order in range(top, 0, -1):
            now = waiting >= order
            rows = todo[now]
            at = self.levels[order - 1].find(hashes[order - 1][rows])
            hit = at >= 0
            logp[rows[hit]] += self.levels[order - 1].logp[at[hit]]
            miss = rows[~hit]
            if order > 1 and len(miss):
                context = self.levels[order - 2].find(hashes[order - 2][miss - 1])
                seen = context >= 0
                logp[miss[seen]] += self.levels[order - 2].back[context[seen]]
            elif order == 1:
                logp[miss] += self.unseen
            keep = ~now
            keep[np.flatnonzero(now)[~hit]] = True
            todo, waiting = todo[keep], waiting[keep]
        total = np.zeros((len(texts), k))
        sums = np.r_[np.zeros((1, k)), np.cumsum(logp, axis=0, dtype=np.float64)]
        total = sums[begins[1:]] - sums[begins[:-1]]
        letters = np.r_[0, np.cumsum(chars != 32)]
        count = np.maximum(np.diff(begins) - 1, 1)
        return -total / count[:, None] / math.log10(2), letters[begins[1:]] - letters[begins[:-1]]


def build(languages: list[str], counts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> LanguageModel:
    """Models from, for each (language, order): hashes, hashes of their first n-1 characters, of their last n-1, and counts."""
    k = len(languages)
    if not k:
        none = np.zeros((0, 0), np.float32)
        return LanguageModel([], [Level(SortedIndex(np.zeros(0, np.uint64)), none, none) for _ in range(ORDER)], np.zeros(0, np.float32), np.zeros(0))
    levels = []
    lower: list[dict] = [{} for _ in range(k)]  # per language: sorted keys and probabilities of the order below
    unseen = np.zeros(k)
    tables = []
    for order in range(1, ORDER + 1):
        per = []
        for lang in range(k):
            h, context, suffix, count = counts.get((lang, order), (np.zeros(0, np.uint64),) * 3 + (np.zeros(0),))
            if order < ORDER:
                # Kneser-Ney: a lower order counts the unlike characters that come before.
                _, _, above, _ = counts.get((lang, order + 1), (np.zeros(0, np.uint64),) * 3 + (np.zeros(0),))
                place = np.searchsorted(h, above)
                place = place[(place < len(h)) & (h[np.minimum(place, max(len(h) - 1, 0))] == above)] if len(h) else place[:0]
                count = np.maximum(np.bincount(place, minlength=len(h)).astype(float), 1.0)
            if order == 1:
                total = max(count.sum(), 1.0)
                kinds = len(h) + 1
                rest = DISCOUNT * max(len(h), 1) / total
                p = (count - DISCOUNT) / total + rest / kinds
                unseen[lang] = math.log10(max(rest, 1e-9) / kinds / 1000)
                per.append((h, p, np.zeros(0, np.uint64), np.zeros(0)))
            else:
                groups, inverse = np.unique(context, return_inverse=True)
                total = np.bincount(inverse, count, len(groups)) if len(groups) else np.zeros(0)
                kinds = np.bincount(inverse, minlength=len(groups)).astype(float)
                weight = DISCOUNT * kinds / np.maximum(total, 1e-9)
                keys, probs = lower[lang]["keys"], lower[lang]["p"]
                place = np.minimum(np.searchsorted(keys, suffix), max(len(keys) - 1, 0))
                below = np.where(keys[place] == suffix, probs[place], 10 ** unseen[lang]) if len(keys) else np.zeros(0)
                p = (count - DISCOUNT) / np.maximum(total[inverse], 1e-9) + weight[inverse] * below if len(h) else np.zeros(0)
                per.append((h, p, groups, weight))
            lower[lang] = {"keys": h, "p": per[-1][1]}
        tables.append(per)
    for order in range(ORDER):
        keys = np.unique(np.concatenate([x[0] for x in tables[order]]))
        logp = np.full((len(keys), k), np.nan, np.float32)
        back = np.zeros((len(keys), k), np.float32)
        for lang, (h, p, _, _) in enumerate(tables[order]):
            logp[np.searchsorted(keys, h), lang] = np.log10(np.maximum(p, 1e-12))
            if order + 1 < ORDER:
                _, _, groups, weight = tables[order + 1][lang]
                known = np.isin(groups, keys)
                back[np.searchsorted(keys, groups[known]), lang] = np.log10(np.maximum(weight[known], 1e-6))
        levels.append(Level(SortedIndex(keys), logp, back))
    _fill(levels, counts, unseen, k)
    return LanguageModel(languages, levels, unseen.astype(np.float32), np.full(k, np.inf))


def _fill(levels: list[Level], counts: dict, unseen: np.ndarray, k: int) -> None:
    """Give n-grams that only other languages have seen their backed-off probability in this language."""
    parents: list[dict] = []
    for order in range(1, ORDER + 1):
        level = levels[order - 1]
        pre, suf = np.zeros(len(level.keys), np.uint64), np.zeros(len(level.keys), np.uint64)
        for lang in range(k):
            if (lang, order) in counts:
                h, context, suffix, _ = counts[lang, order]
                at = np.searchsorted(level.keys, h)
                pre[at], suf[at] = context, suffix
        parents.append({"pre": pre, "suf": suf})
        gaps = np.isnan(level.logp)
        for lang in range(k):
            rows = np.flatnonzero(gaps[:, lang])
            if order == 1:
                level.logp[rows, lang] = unseen[lang]
                continue
            below = levels[order - 2]
            context, suffix = below.find(pre[rows]), below.find(suf[rows])
            weight = np.where(context >= 0, below.back[np.maximum(context, 0), lang], 0)
            level.logp[rows, lang] = weight + np.where(suffix >= 0, below.logp[np.maximum(suffix, 0), lang], unseen[lang])


def sample(docs: DataFrame, where: Column, per_language: int = TRAIN_DOCS, held: int = HELD_DOCS) -> DataFrame:
    """(lang, text, held) of about ``per_language`` rows of each language and ``held`` held back, chosen by a hash of their id.

    Of a language with fewer rows all are taken, and held back in the same proportion.
    """
    rows = docs.filter(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], min(1.0, (per_language + held) / r["n"])).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / (1 << 30)
    return rows.filter(draw < share).select("lang", "text", (draw >= share * (per_language / (per_language + held))).alias("held"))


def fit(docs: DataFrame, where: Column) -> LanguageModel:
    """Models of the languages among the rows that pass ``where``; they see text and lang only."""
    rows = materialise(sample(docs, where), "language-sample")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # MAX_LANGUAGES at most
    number = {x: i for i, x in enumerate(languages)}

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["l", "o", "h", "context", "suffix", "n"]
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()])
            for i in np.unique(lang):
                chars, begins = characters([x.as_py() or "" for x in batch.column(1).filter(pa.array(lang == i))])
                hashes, place = gram_hashes(chars, ORDER), _reach(begins, len(chars))
                for order in range(1, ORDER + 1):
                    at = np.flatnonzero(place >= max(1, order - 1))
                    h, first, count = np.unique(hashes[order - 1][at], return_index=True, return_counts=True)
                    end = at[first]
                    context = hashes[order - 2][end - 1] if order > 1 else h
                    suffix = hashes[order - 2][end] if order > 1 else h
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(h), i, np.int32)), pa.array(np.full(len(h), order, np.int32))]
                        + [pa.array(x.view(np.int64)) for x in (h, context, suffix)]
                        + [pa.array(count)],
                        names,
                    )

    counted = rows.filter(~F.col("held")).select("lang", "text").mapInArrow(grams, "l int, o int, h long, context long, suffix long, n long")
    # Bounded by the sample: the n-grams of TRAIN_DOCS texts of each language.
    got = counted.groupBy("l", "o", "h").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("n").alias("n")).toArrow()
    counts = {}
    lang, order = got.column("l").to_numpy(), got.column("o").to_numpy()
    values = [got.column(c).to_numpy() for c in ("h", "context", "suffix", "n")]
    for i in range(len(languages)):
        for o in range(1, ORDER + 1):
            own = np.flatnonzero((lang == i) & (order == o))
            if len(own):
                h = values[0][own].astype(np.int64).view(np.uint64)
                own, h = own[np.argsort(h)], np.sort(h)
                counts[i, o] = (h, values[1][own].view(np.uint64), values[2][own].view(np.uint64), values[3][own].astype(float))
    model = build(languages, counts)
    if languages:
        model.limit = _limits(rows, model, number)
    return model


def _limits(rows: DataFrame, model: LanguageModel, number: dict[str, int]) -> np.ndarray:
    """For each language the quantile ``ACCEPTED`` of the cross-entropy of the texts held back.

    Without such a text nothing is known of other texts, and the limit is that of the
    training texts and a tenth more.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            h, letters = shared.value.cross_entropy(texts)
            ok = letters > 0
            own_h = h[np.arange(len(lang)), lang]
            yield pa.RecordBatch.from_arrays([pa.array(lang[ok].astype(np.int32)), pa.array(own_h[ok]), batch.column(2).filter(pa.array(ok))], ["l", "h", "held"])

    found = rows.select("lang", "text", "held").mapInArrow(own, "l int, h double, held boolean").groupBy("l", "held").agg(F.percentile("h", ACCEPTED).alias("q")).collect()
    limit = np.full(len(model.languages), np.inf)
    for r in sorted(found, key=lambda r: r["held"]):  # what is held back counts last
        limit[r["l"]] = r["q"] if r["held"] else 1.1 * r["q"]
    return limit


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score (0 to 1), accepted, bits (cross-entropy per character).

    lang_pred is the language of lowest cross-entropy, ``und`` if the text is null or
    has no letter (or the model no language); the score is the posterior of that
    language for a text of at most 50 characters of that kind, so that it is not one
    for every longer text.  ``accepted`` is false for ``und`` and where the
    cross-entropy is above the language's limit.

    Defined cases: ties go to the language that sorts first; null and repeated ids give
    a row each; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and size < 1 << 20:
                    some.append(batch.column(1)[at + len(some)].as_py() or "")
                    size += len(some[-1])
                h, letters = m.cross_entropy(some)
                best = np.full(len(some), len(m.languages))
                score, bits, accepted = np.zeros(len(some)), np.zeros(len(some)), np.zeros(len(some), bool)
                ok = np.flatnonzero(letters > 0) if m.languages else np.zeros(0, np.int64)
                if len(ok):
                    best[ok] = h[ok].argmin(axis=1)
                    bits[ok] = h[ok, best[ok]]
                    length = np.minimum(letters[ok], 50)
                    score[ok] = 1 / np.exp2(-(h[ok] - bits[ok, None]) * length[:, None]).sum(axis=1)
                    accepted[ok] = bits[ok] <= m.limit[best[ok]]
                columns = [batch.column(0).slice(at, len(some)), pa.array(names[best], pa.string()), pa.array(score), pa.array(accepted), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "accepted", "bits"])
                at += len(some)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean, bits double")
