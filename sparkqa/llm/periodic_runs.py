"""Periodic runs of words, found on a grammar of the words (Re-Pair).

A run is a stretch of consecutive words with smallest period q, of at least max(6, 4 q) words, that no neighbouring word
extends. Documents are the unit; a task works on a batch of them at once, with numpy.

1. Re-Pair: words get numbers, and pairs of neighbours that occur twice become nonterminals, the most frequent first. A
   round replaces all pairs that are more frequent than the pairs they overlap with (drawn by lot among equals, so that
   few rounds do); a pair that occurs once can never take part in a pair that occurs twice, so its junction is final and
   leaves the work.
2. Each run lies in one nonterminal whose boundary it crosses (the lowest that holds it all), or crosses a final junction.
   So runs are computed once per nonterminal, at its boundary and within its expansion, and at each final junction. On one
   side of the boundary a run has two periods or more, so the words there are a square: its period is looked for among the
   places of equal 2^j-grams between 2^j and 2^(j+1) words away, and how far the period reaches is told by the numbers of
   longer grams, which are numbered exactly, by doubling.
3. A nonterminal's runs hold wherever it is derived; its parts of a longer run merge with the run.

What cannot be in a gram that repeats within its document leaves the gram tables early, so ordinary prose costs little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.llm.shared import documents
from sparkqa.llm.textwork import small_batches

#: Words a run has at least, and periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that are numbered and worked on at once, longer documents aside.
BATCH_WORDS = 500_000


@dataclass
class Grammar:
    """A batch's Re-Pair grammar, in places of words. Rules by number: where each is first derived (start, boundary, end);
    derived: (rule, start) of every derivation; junctions: the final ones."""

    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    derived: np.ndarray
    junctions: np.ndarray


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def re_pair(words: np.ndarray, doc_starts: np.ndarray) -> Grammar:
    """The grammar of several documents whose words have numbers of their own (none is in two documents)."""
    n = len(words)
    symbol, at, length = words.astype(np.int64), np.arange(n), np.ones(n, np.int64)
    linked = np.ones(n, bool)  # with the next symbol, by a junction that is not final
    linked[doc_starts[1:] - 1] = linked[-1:] = False
    final, starts, middles, ends, rules, derived, made = [], [], [], [], [], [], 0
    fresh = int(words.max(initial=-1)) + 1
    while linked.any():
        left = np.flatnonzero(linked)
        keys, which = np.unique(symbol[left] << 32 | symbol[left + 1], return_inverse=True)
        # stretches of one pair after the other overlapping itself, in each of which every second one can be replaced
        opens = np.concatenate(([True], (np.diff(left) != 1) | (np.diff(which) != 0)))
        first = np.flatnonzero(opens)
        sizes = np.diff(np.append(first, len(left)))
        count = np.bincount(which[first], weights=(sizes + 1) // 2, minlength=len(keys)).astype(np.int64)
        lot = np.random.default_rng(len(keys)).permutation(len(keys))
        rank = np.where(count[which] > 1, count[which] * len(keys) + lot[which], -1)
        final.append((at + length)[left[rank < 0]])
        linked[left[rank < 0]] = False
        before = np.where(np.diff(left, prepend=-2)[first] == 1, rank[first - 1], -1)
        last = first + sizes - 1
        after = np.where(np.diff(left, append=n + 2)[last] == 1, rank[(last + 1) % len(left)], -1)
        place = np.arange(len(left)) - np.repeat(first, sizes)
        skip = np.repeat((before > rank[first]).astype(np.int64), sizes)
        beyond = np.repeat(sizes - (after > rank[first]), sizes)
        chosen = (rank >= 0) & (place >= skip) & (place < beyond) & ((place - skip) % 2 == 0)
        chosen &= np.bincount(which[chosen], minlength=len(keys))[which] > 1
        if chosen.any():
            i = left[chosen]
            _, one, number = np.unique(which[chosen], return_index=True, return_inverse=True)
            starts.append(at[i[one]])
            middles.append(at[i[one] + 1])
            ends.append(at[i[one] + 1] + length[i[one] + 1])
            rules.append(made + number)
            derived.append(at[i])
            symbol[i] = fresh + made + number
            length[i] += length[i + 1]
            linked[i] = linked[i + 1]
            linked[i + 1] = False
            made += len(one)
            gone = np.zeros(len(symbol), bool)
            gone[i + 1] = True
        else:
            gone = np.zeros(len(symbol), bool)
        kept = ~gone
        symbol, at, length, linked = symbol[kept], at[kept], length[kept], linked[kept]
        kept = linked | np.concatenate(([False], linked[:-1]))
        symbol, at, length, linked = symbol[kept], at[kept], length[kept], linked[kept]
        n = len(symbol)
    return Grammar(_joined(starts), _joined(middles), _joined(ends), _joined(rules), _joined(derived), _joined(final))


class Grams:
    """Numbers of the 2^j-grams that occur twice in their document; equal numbers mean equal words."""

    def __init__(self, words: np.ndarray):
        self.words, self.places, self.numbers = words, [], []
        again = np.bincount(words, minlength=1)[words] > 1
        places, numbers, size = np.flatnonzero(again), words[again].astype(np.int64), 1
        dense = np.empty(len(words), np.int64)
        while len(places):
            self.places.append(places)
            self.numbers.append(numbers)
            dense[:] = -1
            dense[places] = numbers
            held = places + size < len(words)
            places, numbers = places[held], numbers[held]
            then = dense[places + size]
            held = then >= 0
            places, key = places[held], numbers[held] * len(words) + then[held]
            keys, which, n = np.unique(key, return_inverse=True, return_counts=True)
            held = n[which] > 1
            places, numbers, size = places[held], which[held], 2 * size

    def number(self, j: int, at: np.ndarray) -> np.ndarray:
        """-1 where the gram occurs once or there is none."""
        places = self.places[j]
        i = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[i] == at, self.numbers[j][i], -1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words are equal from the places x and y on."""
        out = np.zeros(len(x), np.int64)
        for j in reversed(range(len(self.places))):
            a = self.number(j, x + out)
            out += np.where((a >= 0) & (a == self.number(j, y + out)), 1 << j, 0)
        return out

    def common_before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words are equal before the places x and y, backwards."""
        out = np.zeros(len(x), np.int64)
        for j in reversed(range(len(self.places))):
            a = self.number(j, x - out - (1 << j))
            out += np.where((a >= 0) & (a == self.number(j, y - out - (1 << j))), 1 << j, 0)
        return out


def crossing(words: np.ndarray, low: np.ndarray, at: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs within [low, high) that hold the words before and after the boundary at: (boundary's index, start, end, period).

    A period may come with a smaller one of the same stretch, and only part of it then (the caller drops those)."""
    grams = Grams(words)
    found: list[list[np.ndarray]] = []
    # of each boundary: how far a run that was found reaches after and before it; in there a longer square is a multiple
    ahead, behind = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)

    def settle(which: np.ndarray, period: np.ndarray, right: bool) -> None:
        """Squares after the boundary (right) or before it."""
        b = at[which]
        x, y = (b, b + period) if right else (b - period, b)
        back = np.minimum(grams.common_before(x, y), x - low[which])
        on = np.minimum(grams.common(x, y), high[which] - y)
        start, end = x - back, y + on
        held = (start < b) & (end > b) & (end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * period))
        which, start, end = which[held], start[held], end[held]
        found.append([which, start, end, period[held]])
        np.maximum.at(ahead, which, end - at[which])
        np.maximum.at(behind, which, at[which] - start)

    every = np.arange(len(at))
    padded = np.concatenate((words, np.full(8, -1, words.dtype)))
    for q in range(1, 4):
        for right in (True, False):
            begin = at if right else at - 2 * q
            held = (begin >= low) & (begin + 2 * q <= high)
            cross = np.where(right, at - 1, at - q)
            held &= padded[cross] == padded[cross + q]
            which = every[held]
            for i in range(q):
                which = which[padded[begin[which] + i] == padded[begin[which] + i + q]]
            settle(which, np.full(len(which), q, np.int64), right)
    m = len(words) + 1
    for j in range(2, len(grams.places)):
        size = 1 << j
        order = np.argsort(grams.numbers[j], kind="stable")
        keys = grams.numbers[j][order] * m + grams.places[j][order]
        for right in (True, False):
            room = (high - at if right else at - low) // 2
            least = np.maximum(size, (ahead if right else behind) // 2 + 1)
            most = np.minimum(2 * size - 1, room)
            which = every[least <= most]
            gram = at[which] if right else at[which] - size
            number = grams.number(j, gram)
            which, gram, number = which[number >= 0], gram[number >= 0], number[number >= 0]
            near, far = gram + least[which], gram + most[which]
            if not right:
                near, far = gram - most[which], gram - least[which]
            lo = np.searchsorted(keys, number * m + np.maximum(near, 0))
            hi = np.searchsorted(keys, number * m + np.maximum(far, -1), side="right")
            n = np.maximum(hi - lo, 0)
            if not n.any():
                continue
            i = np.repeat(np.arange(len(which)), n)
            other = keys[lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)] % m
            settle(which[i], np.abs(other - gram[i]), right)
    return tuple(_joined([f[k] for f in found]).astype(np.int64) for k in range(4))


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of one run (they share a period's words or more) as one; without those that have a smaller period."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    width = int(end.max()) + 1
    group = np.cumsum(np.concatenate(([0], np.diff(period) != 0)))
    upto = np.maximum.accumulate(group * width + end) - group * width
    new = np.concatenate(([True], (np.diff(period) != 0) | (start[1:] > upto[:-1] - period[1:])))
    first = np.flatnonzero(new)
    start, end, period = start[first], np.maximum.reduceat(end, first), period[first]
    kept = np.zeros(len(start), bool)
    have_start, have_end = start[:0], end[:0]
    for q in np.unique(period):
        i = np.flatnonzero(period == q)
        reach = np.concatenate(([-1], np.maximum.accumulate(have_end)))[np.searchsorted(have_start, start[i], side="right")]
        i = i[reach < end[i]]
        kept[i] = True
        order = np.argsort(np.concatenate((have_start, start[i])), kind="stable")
        have_start, have_end = np.concatenate((have_start, start[i]))[order], np.concatenate((have_end, end[i]))[order]
    return start[kept], end[kept], period[kept]


def runs_of(words: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and then period. words: numbers, none in two documents."""
    if not len(words):
        return (np.empty(0, np.int64),) * 3
    g = re_pair(words, doc_starts)
    own = np.flatnonzero(g.end - g.start >= MIN_WORDS)
    doc_ends = np.append(doc_starts[1:], len(words))
    doc = np.searchsorted(doc_starts, g.junctions, side="right") - 1
    low, at = np.concatenate((g.start[own], doc_starts[doc])), np.concatenate((g.middle[own], g.junctions))
    which, start, end, period = crossing(words, low, at, np.concatenate((g.end[own], doc_ends[doc])))
    in_rule = which < len(own)
    # a rule's runs go to all places where it is derived
    order = np.argsort(g.rule, kind="stable")
    counts = np.bincount(g.rule, minlength=len(g.start))
    begins = np.cumsum(counts) - counts
    rule = own[which[in_rule]]
    i = np.repeat(np.arange(len(rule)), counts[rule])
    places = g.derived[order[begins[rule][i] + np.arange(len(i)) - np.repeat(np.cumsum(counts[rule]) - counts[rule], counts[rule])]] if len(i) else i
    moved = places - g.start[rule][i]
    start, end, period = (
        np.concatenate((start[~in_rule], start[in_rule][i] + moved)), np.concatenate((end[~in_rule], end[in_rule][i] + moved)), np.concatenate((period[~in_rule], period[in_rule][i]))
    )
    start, end, period = _merged(start, end, period)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _told(texts: list[str]) -> Iterator[tuple[list, list, list, str]]:
    """Starts, lengths and periods of each text's runs, and its words without the repeats."""
    split, numbers, starts, n = [], [], [], 0
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()  # at \x20 and \x09-\x0D, as of bytes
        ids: dict[bytes, int] = {}
        numbers.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
        split.append(words)
        starts.append(n)
        n += len(words)
    fresh = np.cumsum([0, *(int(x.max(initial=-1)) + 1 for x in numbers)])
    full = [i for i, words in enumerate(split) if words]
    every = np.concatenate([numbers[i] + fresh[i] for i in full]) if full else np.empty(0, np.int64)
    start, end, period = runs_of(every, np.array([starts[i] for i in full], dtype=np.int64))
    lo = np.searchsorted(start, starts)
    hi = np.append(lo[1:], len(start))
    for words, offset, a, b in zip(split, starts, lo.tolist(), hi.tolist(), strict=True):
        if a == b:
            yield [], [], [], b" ".join(words).decode("utf-8", "surrogatepass")
            continue
        s, e, q = start[a:b] - offset, end[a:b] - offset, period[a:b]
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, s + q, 1)
        np.add.at(edges, e, -1)
        kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
        yield s.tolist(), (e - s).tolist(), q.tolist(), b" ".join([words[i] for i in kept]).decode("utf-8", "surrogatepass")


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # as many texts at once as have BATCH_WORDS by their length, in which a word and its blank take two characters at least
        size, group = 0, []
        for text in batch["text"]:
            size += len(text) // 2 + 1
            group.append(size // BATCH_WORDS)
        for _, part in batch.groupby(np.array(group, dtype=np.int64), sort=True):
            told = list(_told(part["text"].tolist()))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), **{c: [t[k] for t in told] for k, c in enumerate(("starts", "lengths", "periods", "collapsed"))}}).astype({"doc_id": "Int64"})


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, runs (array of start, length and period, in words from 0, by start and then period),
    collapsed (the words joined by blanks, without those that a run holds after its first period).

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and no runs; texts are taken whole, and one text
    is worked on in one task; repeated rows and null ids are rows of their own; an empty table gives no rows; other columns
    are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInPandas(_found, "doc_id long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    runs = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")))
    return found.select("doc_id", runs.alias("runs"), "collapsed")


BLANKS = r"[\x20\x09-\x0D]+"


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, every tenth text (by the CRC-32 of its id) with words of a period of its own from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (h % 10 == 0).alias("chosen"), g.alias("g"))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    some = rows.where("chosen").select("doc_id", words.alias("words"), "g", F.size(words).alias("n"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(0).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    cycle = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.where("not coalesce(chosen, false)").select("doc_id", "text").unionByName(some.select("doc_id", F.array_join(cycle, " ").alias("text")))


def _hex(text: Column) -> Column:
    return F.sha2(text, 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(documents(spark, sf_dir)))
    best = F.reduce("runs", F.lit(None).cast(found.schema["runs"].dataType.elementType), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        _hex(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"), _hex(F.col("collapsed")).alias("collapsed_sha256"),
    )
