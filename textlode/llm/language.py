"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; runs of characters that are not letters become one border. N-grams of ORDER characters are counted over all
labelled rows, each task adding up its own before the shuffle. The counts of the longest n-grams determine everything
else: shorter orders use the number of distinct characters in front. The model holds sorted arrays of n-gram hashes with the
interpolated probabilities of every language, and of contexts with their back-off weights; a text is looked up by binary
search. No counted n-gram is left out: the model is cut into shards by the two middle characters of the n-grams, each fitted and held by
itself, and a text's cross-entropy is the sum over the shards. The language of the lowest cross-entropy per character wins. A prediction is accepted if its cross-entropy is
no higher than that of nearly all labelled texts of the language, and its score is a softmax of the
negative cross-entropies with a temperature fitted to all labelled texts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
SLICE = 1 << 20
#: About so many probabilities (counted rows times languages) are in memory at once, as one shard of the model.
SHARD_CELLS = 12_000_000
#: Bounds of `calibration`.
CALIBRATION_ROWS, CALIBRATION_CHARS = 2000, 8_000_000
#: Characters that are scored by one pass over the shards of a cut model.
ROUND_CHARS = 16_000_000
ACCEPTED_SHARE = 0.995
#: What the temperature is chosen from.
TEMPERATURES = [2.0**e for e in np.arange(-2, 6.5, 0.5).tolist()]
UNKNOWN = "und"


def letters() -> np.ndarray:
    """16-bit code of the lower-case form of each letter of the basic plane, 0 for other characters."""
    out = np.zeros(1 << 16, np.uint64)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            out[code] = ord(c.lower()[0]) & 0xFFFF
    return out


def grams(text: str, table: np.ndarray):
    """Hashes of the windows of ORDER characters of a text, in slices; nothing if it has no letter.

    A hash holds 16 bits a character, the last one lowest. Letters beyond the basic plane are folded into 16 bits.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    tail = np.zeros(ORDER - 1, np.uint64)
    for at in range(0, len(codes), SLICE):
        part = codes[at : at + SLICE]
        x = table[np.minimum(part, len(table) - 1)]
        high = part >= len(table)
        if high.any():
            own = [1 + c % 65521 if chr(c).isalpha() else 0 for c in part[high].tolist()]
            x[high] = np.array(own, np.uint64)
        x = np.r_[tail, x, np.zeros(1 if at + SLICE >= len(codes) else 0, np.uint64)]
        # One border between words: drop a border that follows another one, but keep the padding in front.
        keep = np.r_[np.ones(ORDER - 1, bool), (x[ORDER - 1 :] > 0) | (x[ORDER - 2 : -1] > 0)]
        x = x[keep]
        if len(x) < ORDER:
            continue
        h = np.zeros(len(x) - ORDER + 1, np.uint64)
        for j in range(ORDER):
            h = (h << np.uint64(16)) | x[j : len(x) - ORDER + 1 + j]
        tail = x[-(ORDER - 1) :]
        yield h


def count_grams(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a text and a label."""

    def run(batches):
        table = letters()
        held: dict[str, list] = {}

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            unique, back = np.unique(keys, return_inverse=True)
            return unique, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            for label, group in batch.groupby("label"):
                found = [h for text in group["text"] for h in grams(text, table)]
                if found:
                    parts = held.setdefault(label, [])
                    parts.append(np.unique(np.concatenate(found), return_counts=True))
                    if sum(len(k) for k, _ in parts) > 4_000_000:
                        held[label] = [merged(parts)]
        for label, parts in held.items():
            keys, n = merged(parts)
            for at in range(0, len(keys), 200_000):
                part = keys[at : at + 200_000]
                yield pd.DataFrame({"lang": label, "gram": part.view(np.int64), "n": n[at : at + 200_000]})

    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    found = rows.mapInPandas(run, "lang string, gram bigint, n bigint")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    grams: list  # per order: sorted hashes, log probabilities (rows: hashes, columns: languages)
    contexts: list  # per order: sorted hashes of contexts, log back-off weights
    floor: float
    temperature: float
    limits: np.ndarray


def _at(keys: np.ndarray, wanted: np.ndarray):
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probs(model: Model, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Log probability of the last character of each n-gram under each language: as stored, or backed off to fewer characters."""
    if order == 0:
        return np.full((len(keys), len(model.langs)), model.floor, np.float32)
    held, probs = model.grams[order - 1]
    at, known = _at(held, keys)
    out = probs[at] if len(held) else np.zeros((len(keys), len(model.langs)), np.float32)
    if not known.all():
        rest = keys[~known]
        weights, backed = model.contexts[order - 1]
        where, found = _at(weights, rest >> np.uint64(16))
        lower = log_probs(model, rest & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        out[~known] = lower + (np.where(found[:, None], backed[where], 0) if len(weights) else 0)
    return out


def discount(once: int, twice: int) -> float:
    """What is taken off each count of an order, from how many n-grams have been counted once and twice."""
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


def place_of(keys: np.ndarray) -> np.ndarray:
    """What shards are ranges of: the last but one character of an n-gram, then the one before it."""
    return (keys >> np.uint64(16) & np.uint64(0xFFFF)) << np.uint64(16) | (keys >> np.uint64(32) & np.uint64(0xFFFF))


def _by_language(counts: pd.DataFrame, langs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per language, sorted n-grams and their counts."""
    tables = []
    for lang in langs:
        own = counts[counts["lang"] == lang]
        key = own["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        tables.append((key[order], own["n"].to_numpy(np.int64)[order]))
    return tables


def fit(
    counts: pd.DataFrame,
    langs: list[str] | None = None,
    lower: dict[int, pd.DataFrame] | None = None,
    cuts: dict[tuple[int, str], float] | None = None,
) -> Model:
    """Interpolated Kneser-Ney models from (lang, gram, n), one per language.

    For a shard, `counts` holds all n-grams of a range of places. As those do not determine the rest, `langs` are all languages, `lower` the
    counts of the orders 1 (all) and 2 (those that begin with a character of the range), and `cuts` the discounts by order and language.
    """
    langs = sorted(counts["lang"].unique()) if langs is None else langs
    per_order = {ORDER: _by_language(counts, langs)}  # per language: grams and counts of the order
    for k in range(ORDER - 1, 0, -1):
        mask = np.uint64((1 << 16 * k) - 1)
        # How many distinct characters stand in front: each n-gram of k + 1 characters counts once.
        per_order[k] = (
            _by_language(lower[k], langs) if lower and k in lower else [np.unique(keys & mask, return_counts=True) for keys, _ in per_order[k + 1]]
        )
    vocabulary = len(np.unique(np.concatenate([keys for keys, _ in per_order[1]]))) + 1 if langs else 1
    model = Model(langs, [], [], float(-np.log(vocabulary)), 1.0, np.zeros(len(langs)))
    for k in range(1, ORDER + 1):
        every = np.unique(np.concatenate([keys for keys, _ in per_order[k]])) if langs else np.empty(0, np.uint64)
        before = np.unique(every >> np.uint64(16))
        lower_probs = log_probs(model, every & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
        probs = np.empty((len(every), len(langs)), np.float32)
        backed = np.zeros((len(before), len(langs)), np.float32)
        for col, (keys, n) in enumerate(per_order[k]):
            if not len(keys):
                probs[:, col] = lower_probs[:, col]
                continue
            cut = cuts[k, langs[col]] if cuts else discount((n == 1).sum(), (n == 2).sum())
            context, back = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(back, n, len(context))
            kinds = np.bincount(back, minlength=len(context))
            weight = cut * kinds / total
            where, _ = _at(before, context)
            backed[where, col] = np.log(weight)
            at, known = _at(keys, every)
            c_at, c_known = _at(context, every >> np.uint64(16))
            base = np.exp(lower_probs[:, col].astype(float))
            seen = np.where(known, n[at] - cut, 0.0) / np.where(c_known, total[c_at], 1.0)
            probs[:, col] = np.log(seen + np.where(c_known, weight[c_at], 1.0) * base)
        model.grams.append((every, probs))
        model.contexts.append((before, backed))
    return model


@dataclass
class Shards:
    """The model of all labels: broadcast shards, of which only one is held in memory."""

    langs: list[str]
    shards: list = field(default_factory=list)  # (first place, first place behind it, broadcast variables of a Model)
    temperature: float = 1.0
    limits: np.ndarray | None = None


def opened(shards: list):
    """The shards one after the other; of several each is let go before the next one is read."""
    for first, behind, shared in shards:
        yield first, behind, Model(**shared.value)
        if len(shards) > 1:
            vars(shared).pop("_value", None)


def add_nats(total: np.ndarray, n: np.ndarray, texts, first: int, behind: int, model: Model, table: np.ndarray) -> None:
    """Add to `total` (texts, languages) the nats of the n-grams of a shard, and to `n` how many they are."""
    whole = first == 0 and behind > 0xFFFFFFFF
    for i, text in enumerate(texts):
        for keys in grams(text, table) if text else ():
            if not whole:
                place = place_of(keys)
                keys = keys[(place >= first) & (place < behind)]
            total[i] -= log_probs(model, keys).sum(0, dtype=np.float64)
            n[i] += len(keys)


def has_letter(text: str, table: np.ndarray) -> bool:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes[codes < len(table)]
    return bool((table[low] > 0).any()) or any(chr(c).isalpha() for c in np.unique(codes[codes >= len(table)]).tolist())


def entropies(batches, shards: list, langs: int):
    """For each batch of texts the cross-entropy per n-gram of each text under each language, and which texts have a letter."""
    table = letters()
    # A single shard stays open for the whole task; of several each is read once for many batches.
    one = list(opened(shards)) if len(shards) == 1 else None
    for held in rounds(batches, ROUND_CHARS if one is None else 0):
        texts = [text for batch in held for text in batch]
        total, n = np.zeros((len(texts), langs)), np.zeros(len(texts), np.int64)
        for first, behind, shard in one or opened(shards):
            add_nats(total, n, texts, first, behind, shard, table)
        lettered = np.array([k > 0 and has_letter(text, table) for text, k in zip(texts, n)], bool)
        total /= np.maximum(n, 1)[:, None]
        at = 0
        for batch in held:
            yield total[at : at + len(batch)], lettered[at : at + len(batch)]
            at += len(batch)


def calibrate(model: Shards, labelled: DataFrame, text_col: str, label_col: str) -> None:
    """Fit the temperature by log loss, and the highest accepted cross-entropy of each language, to all labelled texts with a letter."""
    from textlode.llm.common import staged
    from textlode.operators.scale import running_sums

    langs, shards, temperatures = model.langs, model.shards, np.array(TEMPERATURES)

    @F.pandas_udf("h double, loss array<double>")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        column, truths = {lang: i for i, lang in enumerate(langs)}, deque()

        def texts():
            for text, label in batches:
                truths.append(label)
                yield text

        for h, lettered in entropies(texts(), shards, len(langs)):
            truth = truths.popleft()
            # A text with a letter has been counted, so its label is known.
            own = np.array([column.get(label, 0) for label in truth], int)
            at = np.arange(len(own))
            z = (h[at, own][:, None] - h)[:, None, :] * temperatures[:, None]
            top = z.max(2, keepdims=True)
            loss = top[:, :, 0] + np.log(np.exp(z - top).sum(2))
            values = [x if ok else None for x, ok in zip(h[at, own].tolist(), lettered)]
            yield pd.DataFrame({"h": pd.Series(values, dtype=float), "loss": loss.tolist()})

    label = F.col(label_col).cast("string")
    rows = labelled.select(label.alias("lang"), measure(F.col(text_col), label).alias("_found")).select("lang", "_found.h", "_found.loss")
    rows = staged(rows, "calibration").where("h IS NOT NULL")
    losses = rows.agg(*[F.sum(F.col("loss")[i]).alias(f"l{i}") for i in range(len(temperatures))]).first()
    model.limits = np.full(len(langs), np.inf)
    if losses[0] is None:
        return
    model.temperature = float(temperatures[int(np.argmin(list(losses)))])
    # The quantile by ranks along ranges; equal texts are one row.
    counts = staged(rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")), "calibration-counts")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    wanted = [(lang, int(ACCEPTED_SHARE * (n - 1))) for lang, n in sizes.items()]
    ranked = running_sums(counts, ["lang"], ["h"], {"before": "n"})
    ranked = ranked.join(labelled.sparkSession.createDataFrame(wanted, "lang string, low bigint"), "lang")
    # At most two rows of a language: the values around the quantile.
    ranked = ranked.where("before <= low + 1 AND before + n > low")
    ends: dict[str, list[float]] = {}
    for r in sorted(ranked.collect(), key=lambda r: r["h"]):
        ends.setdefault(r["lang"], []).append(r["h"])
    for i, lang in enumerate(langs):
        if lang in ends:
            at = ACCEPTED_SHARE * (sizes[lang] - 1)
            model.limits[i] = ends[lang][0] + (ends[lang][-1] - ends[lang][0]) * (at - int(at))


def shard_bounds(counts: DataFrame, rows: int, langs: int) -> list[int]:
    """Places that cut the n-grams into ranges of about SHARD_CELLS probabilities, with both ends."""
    shards = -(-rows * langs // SHARD_CELLS)
    inner = counts.stat.approxQuantile("place", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 else []
    return [0, *sorted({int(x) for x in inner} - {0}), 1 << 32]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Shards:
    """Models of all labels of `docs`, from the counts of all its labelled rows.

    Without labelled rows the model has no languages, and every prediction is UNKNOWN with score 0.
    """
    from textlode.llm.common import staged

    gram = F.col("gram")
    place = F.shiftleft(F.shiftright(gram, 16).bitwiseAND(0xFFFF), 16).bitwiseOR(F.shiftright(gram, 32).bitwiseAND(0xFFFF))
    counts = staged(count_grams(docs, text_col, label_col).withColumn("place", place), "grams")
    # Of the shorter orders, the counts of distinct characters in front; order 3 is derived within a shard.
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = gram.bitwiseAND(F.lit((1 << 16 * k) - 1).cast("bigint"))
        orders[k] = orders[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        if k == 2:
            orders[k] = staged(orders[k], "grams-2")
    cuts, rows = {}, 0
    for k, own in orders.items():
        found = own.groupBy("lang").agg(
            F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")
        )
        for r in found.collect():
            cuts[k, r["lang"]] = discount(r["once"], r["twice"])
            rows += r["rows"] if k == ORDER else 0
    model = Shards(sorted(lang for k, lang in cuts if k == ORDER))
    if not model.langs:
        return model
    # At most 65,536 rows of a language.
    ones = orders[1].toPandas()
    bounds = shard_bounds(counts, rows, len(model.langs))
    for first, behind in zip(bounds, bounds[1:]):
        begins = F.shiftright("gram", 16)
        twos = orders[2].where((begins >= first >> 16) & (begins <= (behind - 1) >> 16)).toPandas()
        own = counts.where((F.col("place") >= first) & (F.col("place") < behind)).select("lang", "gram", "n").toPandas()
        shard = fit(own, model.langs, {1: ones, 2: twos}, cuts)
        # As plain lists and arrays, which executors can read without this package.
        model.shards.append((first, behind, docs.sparkSession.sparkContext.broadcast(vars(shard))))
    calibrate(model, docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()), text_col, label_col)
    return model


def calibration(labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[str]]:
    """Texts and labels of a bounded sample to look at: the CALIBRATION_ROWS first by a hash of the id, whose longest give way to CALIBRATION_CHARS.

    No model and no query uses it: `calibrate` reads all labelled rows.
    """
    order, size = F.xxhash64(F.col(id_col), F.lit(2)), F.length(text_col)
    some = labelled.select(order.alias("o"), size.alias("n")).orderBy("o", "n").limit(CALIBRATION_ROWS).toPandas().sort_values(["n", "o"])
    some = some[some["n"].cumsum() <= CALIBRATION_CHARS]
    if some.empty:
        return [], []
    rows = labelled.where(order.isin(some["o"].unique().tolist()) & (size <= int(some["n"].max())))
    rows = rows.select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l"), order.alias("o"))
    rows = rows.limit(len(some)).toPandas().sort_values(["o", "t"])
    return rows["t"].tolist(), rows["l"].tolist()


def rounds(batches, chars: int):
    """Batches together until they hold so many characters."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(len(text) for text in batch if text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def predict(docs: DataFrame, model: Shards, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, with lang_pred, score (0 to 1) and accepted; columns of these names are replaced.

    A text that is null or has no letter is UNKNOWN with score 0 and not accepted. Ties go to the label that sorts first.
    """
    langs, shards, temperature, limits = model.langs, model.shards, model.temperature, model.limits

    def verdict(h):
        best = int(h.argmin())
        return langs[best], float(1.0 / np.exp((h[best] - h) * temperature).sum()), bool(h[best] <= limits[best])

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for h, lettered in entropies(batches, shards, len(langs)):
            rows = [verdict(own) if ok else (UNKNOWN, 0.0, False) for own, ok in zip(h, lettered)]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "accepted"])

    names = ("lang_pred", "score", "accepted")
    out = docs.drop(*names).withColumn("_found", judge(F.col(text_col)))
    return out.select(*[c for c in out.columns if c != "_found"], *[F.col(f"_found.{c}") for c in names])
