"""Language identification by interpolated Kneser-Ney character models.

One character 4-gram model per language. The n-grams of all languages and orders are kept in
sorted arrays of hashed keys (four 8-bit symbol codes in one unsigned 32-bit integer) beside a
row of per-language log-probabilities, so that scoring is a binary search per position. A text
gets the language of the lowest cross-entropy per symbol.

Training: the counts come from a sample of whole labelled texts whose expected size is
``docs_per_lang`` documents of each language (a documented bound; chosen by a hash of
``doc_id``, so the same rows give the same model). Counting runs on the executors; the model's
size is bounded by the sample. A second, disjoint sample of ``calibration_per_lang`` documents
fits the confidence and the rejection limits: for each language and each doubling of a text's
letters, the ``REJECT_QUANTILE`` of the cross-entropies of calibration texts, and pieces of them, of about that many letters, and
``REJECT_DEVIATIONS`` standard deviations more (``REJECT_BITS`` at least). So a few calibration texts that are no prose
don't widen the limits, as long as they are fewer than the quantile leaves out.

Defined results: letters are what Unicode calls one (category L); a null text or one without letters is ``und`` with score 0 and is rejected;
null labels teach nothing; equal cross-entropies go to the alphabetically first language;
repeated rows are scored alike; without any labelled row every text is ``und``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import arrow_map, hash_fraction

UND = "und"
ORDER = 4
STEP = 1 << 19  # symbols worked on at once
SPACE = 1  # the symbol of everything that is not a letter; 0 pads nothing and never occurs
DISCOUNT = 0.75
DOCS_PER_LANG = 1500
CALIBRATION_PER_LANG = 200
#: A text is rejected whose bits per symbol exceed this quantile of calibration texts of its length by so many standard deviations.
REJECT_QUANTILE, REJECT_DEVIATIONS = 0.995, 2.0
#: ... and by so many bits at least: long texts vary little, but a few hold much that is not prose.
REJECT_BITS = 0.5
#: Lengths in code points of the pieces of calibration texts, and how many of each a text gives.
PIECES, PIECES_OF_TEXT = (6, 12, 24, 48, 96, 192, 384, 768), 4
LENGTHS = 24  # doublings of letters that have a limit


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the symbol (lower-case a-z keep a code each, other letters and marks share the rest by hash), and whether it is a letter."""
    table, letter = np.full(0x110000, SPACE, np.uint8), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L" or kind == "M":
            table[cp] = cp - 97 + 2 if 97 <= cp <= 122 else 27 if cp > 65535 else 28 + (cp * 2654435761 >> 7) % 228
            letter[cp] = kind == "L"
    return table, letter


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each text starting and ending with one SPACE, each text's offset, and which symbols are letters."""
    table, letter = _tables()
    joined = "\n".join(t or "" for t in texts).lower() if all(t is None or t.isascii() for t in texts) else None
    if joined is None:
        parts = [(t or "").lower() for t in texts]
        joined, sizes = "\n".join(parts), np.array([len(p) for p in parts], np.int64)
    else:
        sizes = np.array([len(t or "") for t in texts], np.int64)
    cps = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    syms = table[cps]
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)  # the separator before each text
    keep = np.ones(len(syms), bool)
    keep[1:] = (syms[1:] != SPACE) | (syms[:-1] != SPACE)
    keep[starts] = True
    where = np.cumsum(keep) - 1
    return syms[keep], where[starts], letter[cps[keep]]


def grams(syms: np.ndarray, n: int) -> np.ndarray:
    """The packed n-gram ending at each symbol; the first n - 1 are padded with SPACE."""
    padded = np.concatenate((np.full(n - 1, SPACE, np.uint8), syms)).astype(np.uint32)
    out = np.zeros(len(syms), np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | padded[k : k + len(syms)]
    return out


@dataclass
class Model:
    """keys[n]: sorted hashed n-grams; logp[n]: their log2-probabilities, a column a language; back[n]: log2 of the back-off weight of an n-gram as a context."""

    langs: list[str]
    keys: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    back: dict[int, np.ndarray]
    floor: float
    limit: np.ndarray | None = None
    slope: float = 4.0

    def position_scores(self, syms: np.ndarray) -> np.ndarray:
        return self._level(grams(syms, ORDER), ORDER)

    def _level(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full((len(keys), len(self.langs)), self.floor, np.float32)
        at = np.searchsorted(self.keys[n], keys)
        at[at == len(self.keys[n])] = 0
        hit = self.keys[n][at] == keys
        out = self.logp[n][at]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            gone = keys[miss]
            lower = self._level(gone & np.uint32((1 << 8 * (n - 1)) - 1), n - 1)
            if n > 1:
                context = gone >> np.uint32(8)
                k = np.searchsorted(self.keys[n - 1], context)
                k[k == len(self.keys[n - 1])] = 0
                known = (self.keys[n - 1][k] == context)[:, None]
                lower = lower + np.where(known, self.back[n - 1][k], np.float32(0))
            out[miss] = lower
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol, a row a text and a column a language; number of letters."""
        bits, letters, lo = [np.zeros((0, len(self.langs)))], [np.zeros(0, np.int64)], 0
        while lo < len(texts):  # so many texts at a time that memory stays bounded
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= STEP):
                size += len(texts[hi] or "")
                hi += 1
            b, n = self._some(texts[lo:hi])
            bits.append(b)
            letters.append(n)
            lo = hi
        return np.concatenate(bits), np.concatenate(letters)

    def _some(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        syms, starts, is_letter = symbols(texts)
        ends = np.concatenate((starts[1:], [len(syms)]))
        total = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts), np.int64)
        for lo in range(0, len(syms), STEP):
            hi = min(len(syms), lo + STEP)
            before = max(0, lo - ORDER + 1)
            scores = self._level(grams(syms[before:hi], ORDER)[lo - before :], ORDER)
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
            cuts = np.maximum(starts[first:last], lo) - lo
            total[first:last] += np.add.reduceat(scores, cuts, axis=0, dtype=np.float64)
            letters[first:last] += np.add.reduceat(is_letter[lo:hi], cuts, dtype=np.int64)
        return -total / (ends - starts)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score between 0 and 1, and whether calibration accepts the text as any learned language."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        bits, letters = self.cross_entropy(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        weight = np.exp2(-self.slope * np.sqrt(np.minimum(letters, 400))[:, None] * (bits - low[:, None]))
        score = np.where(letters > 0, 1 / weight.sum(axis=1), 0.0)
        limit = self.limit[best, _doublings(letters)] if self.limit is not None else np.inf
        fine = (letters > 0) & (low <= limit)
        return [self.langs[b] if n else UND for b, n in zip(best, letters)], score, fine


def _doublings(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), LENGTHS - 1)


def _pieces(text: str) -> list[str]:
    """Parts of a text of several lengths, evenly spread over it."""
    out = []
    for size in PIECES:
        room = len(text) - size
        if room > 0:
            out += [text[at : at + size] for at in {room * k // PIECES_OF_TEXT for k in range(PIECES_OF_TEXT)}]
    return out


def _limits(n_lang: int, lang: np.ndarray, letters: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest accepted bits per symbol by language and doubling of letters, from measured texts; longer texts have no higher limit."""
    out = np.full((n_lang + 1, LENGTHS), np.inf)
    length = _doublings(letters)
    for k in range(n_lang + 1):
        for d in range(LENGTHS):
            x = low[((lang == k) | (k == n_lang)) & (length == d)]
            if len(x) >= 5:
                out[k, d] = np.quantile(x, REJECT_QUANTILE) + max(REJECT_DEVIATIONS * x.std(), REJECT_BITS)
    own = np.where(np.isinf(out[:n_lang]), out[n_lang], out[:n_lang])  # what no text of a language measures, those of all do
    return np.minimum.accumulate(own, axis=1)


def _kneser_ney(langs: list[str], counts: list[dict[int, np.ndarray]]) -> Model:
    """counts[l]: the (key, count) arrays of language l's 4-grams under 0 and 1."""
    n_lang = len(langs)
    raw: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in range(1, ORDER + 1)}
    for c in counts:
        keys, values = c[0], c[1].astype(np.float64)
        raw[ORDER].append((keys, values))
        for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
            keys, values = np.unique(keys & np.uint32((1 << 8 * n) - 1), return_counts=True)
            raw[n].append((keys, values.astype(np.float64)))
    vocabulary = len(np.unique(np.concatenate([r[0] for r in raw[1]]))) + 1
    floor = -np.log2(vocabulary)
    keys_of, logp, back = {}, {}, {}
    lower_p = None
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([r[0] for r in raw[n]]))
        p = np.zeros((len(keys), n_lang))
        context = keys >> np.uint32(8)
        for l, (k, v) in enumerate(raw[n]):
            groups, inverse = np.unique(k >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(inverse, v), np.bincount(inverse)
            at = np.searchsorted(groups, context)
            at[at == len(groups)] = 0
            known = groups[at] == context
            mine = np.zeros(len(keys))
            mine[np.searchsorted(keys, k)] = np.maximum(v - DISCOUNT, 0)
            weight = np.where(known, DISCOUNT * kinds[at] / total[at], 1.0)
            share = np.where(known, mine / total[at], 0.0)
            if n == 1:
                below = np.full(len(keys), 1 / vocabulary)
            else:
                j = np.searchsorted(keys_of[n - 1], keys & np.uint32((1 << 8 * (n - 1)) - 1))
                below = lower_p[j, l]
            p[:, l] = share + weight * below
            if n > 1:  # the weight of each context, for n-grams no language has
                ctx_at = np.searchsorted(groups, keys_of[n - 1])
                ctx_at[ctx_at == len(groups)] = 0
                seen = groups[ctx_at] == keys_of[n - 1]
                back.setdefault(n - 1, np.zeros((len(keys_of[n - 1]), n_lang), np.float32))[:, l] = np.log2(np.where(seen, DISCOUNT * kinds[ctx_at] / total[ctx_at], 1.0))
        keys_of[n], logp[n], lower_p = keys, np.log2(p).astype(np.float32), p
    return Model(langs, keys_of, logp, back, float(floor))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, calibration_per_lang: int = CALIBRATION_PER_LANG) -> Model:
    """Fit the models on a sample of ``labelled`` of the documented size."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {}, {}, 0.0)
    u = hash_fraction("i", 9)
    in_train, in_calibration = F.lit(False), F.lit(False)
    for l in langs:
        share = min(1.0, docs_per_lang / sizes[l])
        more = min(1.0, (docs_per_lang + calibration_per_lang) / sizes[l])
        if more - share < 0.5 * calibration_per_lang / sizes[l]:
            share, more = min(share, 0.9), 1.0
        in_train = in_train | ((F.col("l") == l) & (u < share))
        in_calibration = in_calibration | ((F.col("l") == l) & (u >= share) & (u < more))

    def count(batch: dict) -> dict:
        texts, ls = batch["t"].to_pylist(), np.array(batch["l"].to_pylist())
        out_l, out_k, out_n = [], [], []
        for l in sorted(set(ls.tolist())):
            for t in (t for t, m in zip(texts, ls == l) if m):
                k, n = np.unique(grams(symbols([t])[0], ORDER), return_counts=True)
                out_l += [l] * len(k)
                out_k.append(k.astype(np.int64))
                out_n.append(n)
        return {"l": out_l, "k": pa.array(np.concatenate(out_k)), "n": pa.array(np.concatenate(out_n))}

    table = arrow_map(rows.where(in_train), count, "l string, k bigint, n bigint").groupBy("l", "k").agg(F.sum("n").alias("n")).orderBy("l", "k").toArrow()
    names = table.column("l").to_numpy()
    keys, ns = table.column("k").to_numpy().astype(np.uint32), table.column("n").to_numpy()
    langs = [l for l in langs if (names == l).any()]
    if not langs:
        return Model([], {}, {}, {}, 0.0)
    model = _kneser_ney(langs, [{0: keys[names == l], 1: ns[names == l]} for l in langs])

    def measure(batch: dict) -> dict:
        texts, labels = batch["t"].to_pylist(), batch["l"].to_pylist()
        bits, letters = model.cross_entropy(texts)
        best = bits.argmin(axis=1)
        right = np.array([langs[b] == l for b, l in zip(best, labels)])
        gap = np.sort(bits, axis=1)
        margin = gap[:, 1] - gap[:, 0] if len(langs) > 1 else np.ones(len(bits))
        parts = [(k, p) for k, t in enumerate(texts) if right[k] for p in _pieces(t)]
        of = np.array([k for k, _ in parts], np.int64)
        more, more_letters = model.cross_entropy([p for _, p in parts])
        n, every = len(parts), np.concatenate
        return {"b": every((best, best[of])).astype(np.int64), "low": every((bits.min(axis=1), more.min(axis=1) if n else np.zeros(0))), "margin": every((margin, np.zeros(n))), "letters": every((letters, more_letters)), "good": every((right, np.ones(n, bool))), "whole": np.arange(len(texts) + n) < len(texts)}

    every_seen = arrow_map(rows.where(in_calibration), measure, "b bigint, low double, margin double, letters bigint, good boolean, whole boolean").where("letters > 0 and (good or whole)").toArrow()
    seen = every_seen.filter(every_seen.column("good"))
    model.limit = _limits(len(langs), seen.column("b").to_numpy(), seen.column("letters").to_numpy(), seen.column("low").to_numpy())
    seen = every_seen.filter(every_seen.column("whole"))
    good = seen.column("good").to_numpy()
    x = seen.column("margin").to_numpy() * np.sqrt(np.minimum(seen.column("letters").to_numpy(), 400))
    if len(x) and not good.all():  # the slope of least log-loss on the calibration texts
        grid = np.linspace(0.25, 16, 64)
        model.slope = float(min(grid, key=lambda s: np.mean(np.log2(1 + np.exp2(-s * np.where(good, x, -x))))))
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", accepted_out: str = "accepted") -> DataFrame:
    """``docs`` with the predicted language, the score and whether calibration accepts it; a map without shuffle.

    The model travels by broadcast; its size is bounded by the training sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passing = [c for c in docs.columns if c not in (lang_out, score_out, accepted_out)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passing] + [f"`{lang_out}` string, `{score_out}` double, `{accepted_out}` boolean"])

    def run(batch: dict) -> dict:
        langs, scores, fine = shared.value.predict(batch[text_col].to_pylist())
        return {c: batch[c] for c in passing} | {lang_out: langs, score_out: scores, accepted_out: fine}

    return arrow_map(docs.select(*passing), run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
