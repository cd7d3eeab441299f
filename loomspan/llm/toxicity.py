"""Toxicity of texts whose words may be disguised: noisy-channel restoration, then a score of the restored text.

Disguised stretches (letters mixed with look-alike signs, letters repeated three times and more, single letters set apart) become
character lattices: each sign may stand for the letters it looks like or for itself, a run of a letter for one or two of it, a
separator between single letters for a blank or for nothing. Viterbi decoding finds the path that a trigram character language model
and the channel's costs like best. The model's counts are gathered over all documents; their number is bounded by the alphabet.

The scorer is a logistic regression on few features (words, and beginnings that one, two or three distinct words have), learned
from labelled rows that are not held out: candidates are counted by Spark over a bounded sample of labelled texts (SAMPLE, about),
and taken greedily while each explains toxic texts that fewer than DEPTH before it did; the weights are fitted on that sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import binary_rows, is_held_out, map_batches, may_learn, read
from loomspan.llm.registry import query
from loomspan.llm.work import Work

SAMPLE = 20_000  # labelled texts that the scorer is fitted on, about
SUPPORT = 4  # toxic texts a feature must explain that fewer than DEPTH features before it did
DEPTH = 4
PRECISION = 0.5  # share of toxic ones among the texts with a candidate feature, at least
PREFIXES = (4, 5, 6, 7, 8)
CANDIDATES = 20_000
STEPS = 400
LONGEST = 48  # bytes of a word that is a feature as a whole
CACHED = 64  # characters of a stretch whose restoration is remembered

#: Letters that a sign stands for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "+": "t", "(": "c"}
ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
BLANK, OTHER = 0, len(ALPHABET)
SIZE = OTHER + 1
SYMBOL = np.full(0x250, OTHER, np.int64)
for _i, _c in enumerate(ALPHABET):
    if ord(_c) < 0x250:
        SYMBOL[ord(_c)] = _i
SYMBOL[[9, 10, 11, 12, 13]] = BLANK
SYMBOL_OF = {c: i for i, c in enumerate(ALPHABET)}

# Language model -----------------------------------------------------------------------------------------


def symbols(text: str) -> np.ndarray:
    """Alphabet numbers of the lower-cased characters; a blank in front and behind."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    return SYMBOL[np.minimum(points, 0x24F)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over whole texts of all rows, in one array of SIZE^3."""
    def count(batch):
        total, held = np.zeros(SIZE ** 3, np.int64), []
        for raw in binary_rows(batch, "text"):
            if raw:
                s = symbols(raw.decode())
                held.append((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:])
                if sum(map(len, held[-64:])) > 1 << 18 or len(held) >= 256:
                    total += np.bincount(np.concatenate(held), minlength=SIZE ** 3)
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=SIZE ** 3)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(SIZE ** 3, np.int64)
    for code, n in map_batches(docs.select("text"), count, "code long, n long", rows=1 << 30).groupBy("code").agg(F.sum("n")).collect():
        out[code] = n
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log chance of a symbol after two others: trigram, bigram and unigram shares mixed."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    chance1 = (one + 1.0) / (one.sum() + SIZE)
    chance2 = (two + 5.0 * chance1) / (two.sum(axis=1, keepdims=True) + 5.0)
    chance3 = (three + 5.0 * chance2[None]) / (three.sum(axis=2, keepdims=True) + 5.0)
    return np.log(chance3).astype(np.float32)


# Restoration ------------------------------------------------------------------------------------------------

_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*]{1,2}[^\W_](?![^\W_])){2,}")
_SIGNS = frozenset(LOOKS_LIKE) | {"*"}
_ANY_SIGN = re.compile(r"[0-9@$!|€+(*]")
_EDGES = ".,;:?!\"'()[]{}<>"
_CODE = re.compile(r"[$€+(-]*[0-9][0-9.,:;/()%+\-*$€]*|\*+")  # numbers, prices, dates, addresses; stars alone say nothing
_LETTERS = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_NARROW = re.compile(r"[^\W_][ .\-_*][^\W_]")
_REPEATED = re.compile(r"[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")

SIGN_COST, ANY_COST, KEEP_COST, DROP_COST, DOUBLE_COST = 0.7, math.log(26.0), 5.0, 1.0, 0.7
WIDE = 200  # paths times choices from which steps are taken for all states at once
BLOCK = 256  # such steps before their paths are written out


def lattice(token: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """For each unit of a token what it may stand for, with its cost."""
    out, i = [], 0
    # two blanks part words if other signs or single blanks part the letters
    wide = spaced and "  " in token and _NARROW.search(token) is not None
    while i < len(token):
        c = token[i]
        run = i + 1
        while run < len(token) and token[run] == c:
            run += 1
        if c.isalpha():
            n = run - i
            out.append([(c, 0.0 if n != 2 else DOUBLE_COST), (c + c, 0.0 if n == 2 else DOUBLE_COST)] if n > 1 else [(c, 0.0)])
            i = run
            continue
        if wide and c == " " and run > i + 1:
            out.append([(" ", 0.0), ("", KEEP_COST)])
            i = run
            continue
        choices = [(letter, SIGN_COST) for letter in LOOKS_LIKE.get(c, "")]
        if c == "*":
            choices += [(letter, ANY_COST) for letter in ALPHABET[1:27]]
        if spaced and c in " .-_*":
            choices += [("", 0.0), (" ", 2 * KEEP_COST if wide else 2 * DROP_COST)]
        elif c in ".-_*'":
            choices += [("", 2 * DROP_COST), (c, KEEP_COST if c == "*" else 0.0)]
        else:
            choices.append((c, KEEP_COST))
        out.append(choices)
        i += 1
    return out


def wide_steps(paths: dict, units: list, model: np.ndarray) -> dict:
    """What steps of decode give, over arrays, for choices of at most one character."""
    used = sorted({s for state in paths for s in state} | {SYMBOL_OF.get(w, OTHER) for choices in units for w, _ in choices if w})
    place, n = {s: i for i, s in enumerate(used)}, len(used)
    chances = model[np.ix_(used, used, used)].astype(float)
    scores, trail = np.full((n, n), -np.inf), []
    for (p, q), (score, _) in paths.items():
        scores[place[p], place[q]] = score
    for choices in units:
        costs, which, drop = np.full(n, np.inf), [""] * n, np.inf
        for written, cost in choices:
            s = place[SYMBOL_OF.get(written, OTHER)] if written else -1
            if s < 0:
                drop = min(drop, cost)
            elif cost < costs[s]:
                costs[s], which[s] = cost, written
        totals = scores[:, :, None] + chances
        first = totals.argmax(axis=0)
        after = np.take_along_axis(totals, first[None], 0)[0] - costs
        stays = scores - drop > after
        trail.append((first, stays, which))
        scores = np.where(stays, scores - drop, after)
    ends = [(int(p), int(q)) for p, q in zip(*np.nonzero(scores > -np.inf), strict=True)]
    before: list[dict] = []  # for each step, latest first: state -> (state before, what was written)
    wanted = set(ends)
    for first, stays, which in reversed(trail):
        before.append({(p, q): ((p, q), "") if stays[p, q] else ((int(first[p, q]), p), which[q]) for p, q in wanted})
        wanted = {state for state, _ in before[-1].values()}
    chains = {state: paths[used[state[0]], used[state[1]]][1] for state in wanted}
    for step in reversed(before):
        chains = {state: (chains[old], written) if written else chains[old] for state, (old, written) in step.items()}
    return {(used[p], used[q]): (float(scores[p, q]), chains[p, q]) for p, q in ends}


def decode(token: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest original of a lower-cased token between blanks.

    A state is two symbols, so that work grows with the length only; a path is a chain of (path before, what was written).
    """
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(BLANK, BLANK): (0.0, None)}
    units, at = [*lattice(token, spaced), [(" ", 0.0)]], 0
    while at < len(units):
        if len(paths) * len(units[at]) > WIDE:
            end = at
            while end < min(len(units), at + BLOCK) and all(len(written) < 2 for written, _ in units[end]):
                end += 1
                if len(units[end - 1]) == 1:
                    break
            if end > at:
                paths, at = wide_steps(paths, units[at:end], model), end
                continue
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in paths.items():
            for written, cost in units[at]:
                p, q, total = a, b, score - cost
                for c in written:
                    s = SYMBOL_OF.get(c, OTHER)
                    total += float(model[p, q, s])
                    p, q = q, s
                known = after.get((p, q))
                if known is None or total > known[0]:
                    after[p, q] = (total, (path, written) if written else path)
        paths, at = after, at + 1
    path, out = max(paths.values(), key=lambda x: x[0])[1], []
    while path is not None:
        path, written = path
        out.append(written)
    return "".join(reversed(out)).strip()


class Restorer:
    """Restores texts under a language model; remembers a bounded number of tokens."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known = lru_cache(maxsize=100_000)(lambda token, spaced: decode(token, model, spaced))

    def decode(self, token: str, spaced: bool) -> str:
        return self.known(token, spaced) if len(token) <= CACHED else decode(token, self.model, spaced)

    def _token(self, token: str) -> str:
        core = token.strip(_EDGES)
        lead = token[: len(token) - len(token.lstrip(_EDGES))]
        if lead[-1:] in ("(", "!") and core:
            core = lead[-1] + core
        if len(core) < 3 or _SIGNS.isdisjoint(core) or _CODE.fullmatch(core):
            return token
        return self.decode(core, False)

    def restore(self, text: str) -> str:
        """The lower-cased text with its disguised stretches restored."""
        low = text.lower()
        letter = _LETTERS[np.frombuffer(low.encode(), np.uint8)]
        if len(letter) > 4:
            raw = np.frombuffer(low.encode(), np.uint8)
            sign = letter | (raw >= 48) & (raw <= 57)
            edge = np.zeros(len(sign) + 2, bool)
            edge[1:-1] = sign
            alone = sign & ~edge[:-2] & ~edge[2:]
            if (alone[:-4] & alone[2:-2] & alone[4:]).any() or (alone[:-3] & alone[3:]).any():
                low = _SPACED.sub(lambda m: self.decode(m[0], True) if any(map(str.isalpha, m[0])) else m[0], low)
            if (letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])).any():
                low = _REPEATED.sub(lambda m: self.decode(m[0], False), low)
        if _ANY_SIGN.search(low):
            low = " ".join(t if _SIGNS.isdisjoint(t) else self._token(t) for t in low.split())
        return low


# Scorer -----------------------------------------------------------------------------------------------------

_WORD_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(restored: str) -> set[bytes]:
    return set(restored.encode().translate(_WORD_BYTES).split())


def beginnings(found: set[bytes], n: int) -> Counter:
    """How many distinct words have each beginning of n bytes and go on behind it."""
    return Counter(w[:n] for w in found if n < len(w))


def features(found: set[bytes]) -> set[bytes]:
    """Words of three and more bytes; b"beginning*1", *2 and *3 for beginnings of at least so many distinct words."""
    out = {w for w in found if 3 <= len(w) <= LONGEST}
    for n in PREFIXES:
        for begin, times in beginnings(found, n).items():
            out.update(b"%s*%d" % (begin, k) for k in range(1, min(times, 3) + 1))
    return out


class Scorer:
    """Weights of features and a bias; few features, so that a text is scored by set operations."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self.whole = {f for f in weights if b"*" not in f}
        self.begins = {n: {f[:n] for f in weights if b"*" in f and len(f) == n + 2} for n in PREFIXES}

    def present(self, found: set[bytes]) -> list[bytes]:
        """The features with a weight that a set of words has, sorted."""
        out = list(self.whole & found)
        for n, begins in self.begins.items():
            if begins and not begins.isdisjoint({w[:n] for w in found}):
                for begin, times in beginnings(found, n).items():
                    if begin in begins:
                        out += [f for k in range(1, min(times, 3) + 1) if (f := b"%s*%d" % (begin, k)) in self.weights]
        return sorted(out)

    def score(self, restored: str) -> float:
        x = self.bias + sum(self.weights[f] for f in self.present(words(restored)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def choose(toxic_texts: dict[bytes, set[int]], seen: dict[bytes, int]) -> list[bytes]:
    """Features taken greedily by the toxic texts they explain that fewer than DEPTH did; ties to precise, whole, first ones."""
    times: Counter = Counter()
    left = set().union(*toxic_texts.values()) if toxic_texts else set()
    pool, out = dict(toxic_texts), []
    while pool:
        gains = {f: len(t & left) for f, t in pool.items()}
        pool = {f: pool[f] for f, gain in gains.items() if gain >= SUPPORT}
        if not pool:
            break
        pick = min(pool, key=lambda f: (-gains[f] * len(pool[f]) / seen[f], b"*" in f, f))
        out.append(pick)
        times.update(pool.pop(pick))
        left -= {t for t in left if times[t] >= DEPTH}
    return out


def regression(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on presence (row, column) pairs; full gradients with momentum."""
    weights, bias = np.zeros(n_features), math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))
    speed, speed_bias = np.zeros(n_features), 0.0
    often = np.bincount(columns, minlength=n_features).astype(float)
    for _ in range(STEPS):
        x = bias + np.bincount(rows, weights=weights[columns], minlength=len(toxic))
        off = 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30))) - toxic
        gradient = np.bincount(columns, weights=off[rows], minlength=n_features) + 0.05 * weights
        speed = 0.9 * speed - gradient / (0.25 * often + 0.05) * 0.2
        speed_bias = 0.9 * speed_bias - off.sum() / (0.25 * len(toxic)) * 0.2
        weights, bias = weights + speed, bias + speed_bias
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray) -> Scorer:
    """Learns from labels of the rows whose id is not held out; equal texts of one label count once."""
    spark = docs.sparkSession
    marks = labels.where(may_learn(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    total, toxic = sum(counts.values()), counts.get(1, 0)
    if not toxic or toxic == total:
        return Scorer({}, math.log((toxic + 0.5) / (total - toxic + 0.5)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("label sample")), F.lit(1 << 30)) / float(1 << 30)
    # the drawn ids are about SAMPLE small rows whatever the corpus; the limit proves the bound of the broadcast
    sample = Work(spark, "toxicity").keep(
        docs.join(F.broadcast(marks.where(draw < min(1.0, SAMPLE / total)).limit(4 * SAMPLE)), "doc_id").where("text IS NOT NULL").groupBy("text", F.col("toxic").cast("int").alias("toxic"))
        .agg(F.min(F.col("doc_id").cast("long")).alias("doc_id")).select("doc_id", "text", "toxic"), "sample")
    sent = spark.sparkContext.broadcast(model)

    def per_text(find):
        """Rows (doc_id, toxic, feature) of what find gives for the words of each sampled text."""
        def run(batches):
            restorer = Restorer(sent.value)
            for batch in batches:
                ids, marked, found = [], [], []
                for doc_id, mark, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), binary_rows(batch, "text"), strict=True):
                    for f in find(words(restorer.restore(raw.decode()))):
                        ids.append(doc_id)
                        marked.append(mark)
                        found.append(f)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marked, pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "toxic", "feature"])
        return sample.mapInArrow(run, "doc_id long, toxic int, feature binary")

    # a candidate keeps the ids of its toxic texts, at most those of the bounded sample
    kept = (per_text(features).groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
            .where((F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * F.col("n")))
            .orderBy(F.col("t").desc(), "feature").limit(CANDIDATES).collect())
    seen = {bytes(r["feature"]): r["n"] for r in kept}
    candidates = Scorer(dict.fromkeys(seen, 0.0), 0.0)
    pairs = [(r[0], r[1], bytes(r[2])) for r in per_text(candidates.present).collect()]
    texts: dict[bytes, set[int]] = {f: set() for f in seen}
    for doc_id, mark, f in pairs:
        if mark:
            texts[f].add(doc_id)
    chosen = {f: i for i, f in enumerate(choose({f: t for f, t in texts.items() if t}, seen))}
    every = sample.select("doc_id", "toxic").collect()
    at = {(r["doc_id"], r["toxic"]): i for i, r in enumerate(sorted(every))}
    marked = np.array([t for _, t in sorted(every)], float)
    some = [(at[d, t], chosen[f]) for d, t, f in pairs if f in chosen]
    rows, columns = (np.array(c, np.int64) for c in zip(*some, strict=True)) if some else (np.empty(0, np.int64),) * 2
    weights, bias = regression(rows, columns, marked, len(chosen))
    return Scorer({f: float(weights[i]) for f, i in chosen.items()}, float(bias))


def score(docs: DataFrame, model: np.ndarray, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from the text alone.

    Null and empty texts score as texts without a feature. Without labels of both kinds every text gets one score.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def run(batches):
        model, scorer = sent.value
        restorer = Restorer(model)
        for batch in batches:
            scores = np.array([scorer.score(restorer.restore(raw.decode()) if raw else "") for raw in binary_rows(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = log_model(trigram_counts(docs))
    return score(docs, model, fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), model))
