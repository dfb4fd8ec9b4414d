"""Toxicity by weak supervision.

1. Lexicons. From the training fold's labelled texts (a bounded sample), words and word beginnings that are far more
   frequent in toxic texts are found by Spark and dealt, strongest first, to a few lexicon voters.
2. Voters. A lexicon votes where a text has one of its entries; density voters say whether entries make up a given share of
   a text's words; pattern voters look at its form. One pass splits each whole text into words, once, and stores which
   entries it has and how the voters voted; everything after that works on these small rows.
3. Generative label model. Votes of all texts outside the held-out fold, labelled or not, are counted by pattern (at most
   2 ** voters rows, whatever the corpus). Expectation maximisation estimates from these counts alone the share of toxic
   texts and, for either class, a forest of voters in which each depends on the one it is most correlated with: accuracies
   and correlations are both part of the likelihood, so a voter that repeats another adds nothing. Labels only say which
   of the two classes is the toxic one.
4. Classifier. A logistic regression on entries, density and form learns the model's posterior labels on a bounded sample
   of texts outside the held-out fold, labelled or not, and scores all texts. Neither labels nor lang, source or doc_id are
   inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.llm.exact_dedup import located
from sparkqa.llm.fingerprint import sketch
from sparkqa.llm.shared import documents, free, quoted, stored
from sparkqa.llm.textwork import small_batches

#: Labelled texts that lexicons may be fitted on, texts that the classifier may be fitted on, lexicon voters, and lengths of
#: word beginnings.
MAX_LABELLED, MAX_FITTED, LEXICONS, BEGINNINGS = 20_000, 40_000, 10, range(4, 9)
#: What an entry needs: log likelihood ratio statistic over texts, and log ratio of its rates among words.
MIN_EVIDENCE, MIN_RATIO = 18.0, 2.5
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
#: Information (nats a text) that two voters must give of each other within the classes to count as correlated.
MIN_TOLD = 0.02
#: Words whose entries a task remembers.
MAX_WORDS = 100_000

_WORD, _CAPITAL = re.compile(r"[^\W\d_]+"), re.compile("[A-Z\xc0-\xde]")


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def forms(word: str) -> list[str]:
    """The word, and its beginnings if it is longer (marked ``*``)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


class Matcher:
    """The entries that texts have, by number; those of words are remembered."""

    def __init__(self, entries: list[str]):
        self.number, self.known = {e: i for i, e in enumerate(entries)}, {}

    def __call__(self, words: Counter) -> tuple[list[int], float]:
        """A text's entries, and the share of its words that have one."""
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        found, hits, known = set(), 0, self.known
        for word, n in words.items():
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(self.number[f] for f in forms(word) if f in self.number)
            if own:
                found.update(own)
                hits += n
        return sorted(found), hits / max(1, words.total())


def shapes(text: str | None) -> list[bool]:
    """Votes of the pattern voters: repeated exclamation marks, many capitals, mixed question and exclamation marks."""
    text = text or ""
    return ["!!" in text, len(_CAPITAL.findall(text)) > 0.3 * max(1, len(text)), "?!" in text]


def form_of(text: str | None, density: float) -> list[bool]:
    """What density and pattern voters say."""
    return [*(density >= d for d in DENSITIES), *shapes(text)]


#: Shares of words at which the density voters speak, and all voters besides the lexicons.
DENSITIES = (0.005, 0.008, 0.012)
FORMS = len(DENSITIES) + 3


def lexicon(labelled: DataFrame) -> list[str]:
    """Words and beginnings that mark toxic texts, strongest first. Copies and near copies of a text (equal smallest hash of
    five-word shingles) say nothing new and count once, as toxic if one is."""

    @F.pandas_udf("long")
    def smallest(texts: pd.Series) -> pd.Series:
        own = [sketch(t, 1) for t in texts]
        return pd.Series([int(h.view(np.int64)[0]) if len(h) else 0 for h in own], dtype="int64")

    one = F.max(F.struct("toxic", F.coalesce("text", F.lit("")).alias("text"))).alias("one")
    labelled = labelled.groupBy(smallest("text").alias("smallest")).agg(one).select("one.*")

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int, int]] = []
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                sums = Counter()
                for word, n in words_of(text).items():
                    sums[""] += n
                    for f in forms(word):
                        sums[f] += n
                out.extend((f, toxic, n) for f, n in sums.items())
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["feature", "toxic", "n"])
                    out = []
        yield pd.DataFrame(out, columns=["feature", "toxic", "n"])

    is_toxic = F.col("toxic") == 1
    counts = labelled.select("text", "toxic").mapInPandas(told, "feature string, toxic int, n long").groupBy("feature").agg(
        F.count_if(is_toxic).alias("a"), F.count_if(~is_toxic).alias("b"), F.sum(F.when(is_toxic, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(is_toxic, 0).otherwise(F.col("n"))).alias("n"))
    counts = stored(counts, "counts")
    whole = counts.where("feature = ''").first()
    if whole is None or not whole.p or not whole.n:
        return []
    ratio = F.log((F.col("p") + 0.1) / whole.p) - F.log((F.col("n") + 0.5) / whole.n)
    part, both = whole.a / (whole.a + whole.b), F.col("a") + F.col("b")
    evidence = 2 * (F.col("a") * F.log(F.col("a") / (both * part)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (both * (1 - part)))).otherwise(0))
    kept = counts.where((F.col("feature") != "") & (F.col("a") > both * part) & (evidence > MIN_EVIDENCE) & (ratio > MIN_RATIO))
    return [r.feature for r in kept.orderBy(F.desc(evidence), "feature").select("feature").collect()]


def deal(entries: list[str], lexicons: int = LEXICONS) -> list[int]:
    """The lexicon voter of each entry: words that begin alike go together, since they say the same; strongest first, in turn."""
    roots: dict[str, int] = {}
    return [roots.setdefault(e[: min(BEGINNINGS)], len(roots)) % lexicons for e in entries]


VOTERS = LEXICONS + FORMS


def marked(docs: DataFrame, entries: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns, ``found`` (numbers of entries) and ``votes`` (a bit for each voter) of each text; stored."""
    lexicons = deal(entries)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(entries)
        for batch in batches:
            found, votes = [], []
            for text in batch["text"]:
                own, density = match(words_of(text))
                bits = 0
                for e in own:
                    bits |= 1 << lexicons[e]
                for i, v in enumerate(form_of(text, density)):
                    bits |= int(v) << (LEXICONS + i)
                found.append(own)
                votes.append(bits)
            yield batch[keep].assign(found=found, votes=votes)

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "found array<int>", "votes int"])
    return stored(docs.select(*quoted(dict.fromkeys([*keep, "text"]))).mapInPandas(mark, schema), "marked")


class LabelModel:
    """Two classes, and for each a forest of binary votes: the class's share, and each vote's rate given its parent's vote.
    Votes that say less than ``MIN_TOLD`` of each other within the classes are taken as independent."""

    def __init__(self, voters: int):
        self.prior, self.parent = 0.5, np.full(voters, -1)
        self.rates = np.full((2, voters, 2), 0.5)  # of a vote, by class and by the parent's vote (a root's: equal)
        self.correlations = np.zeros((voters, voters))

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """The probability of class 1 for rows of votes."""
        of = np.where(self.parent < 0, 0, bits[:, self.parent]).astype(int)
        score = np.full(len(bits), np.log(self.prior / (1 - self.prior)))
        for c, sign in ((1, 1), (0, -1)):
            rate = self.rates[c][np.arange(bits.shape[1]), of]
            score += sign * np.log(np.where(bits > 0, rate, 1 - rate)).sum(1)
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

    def fit(self, bits: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 200, settle: int = 3, tolerance: float = 1e-7) -> LabelModel:
        """bits, counts: patterns of votes and how many texts have each; start: first guess of their class 1. The first
        ``settle`` rounds take voters as independent; then the forest of what the classes do not explain is chosen, once."""
        q, counts = start.astype(float), counts.astype(float)
        for n in range(rounds):
            self._update(bits, counts, q, choose=n == settle)
            last, q = q, self.posterior(bits)
            if n > settle and np.abs(last - q).max() < tolerance:
                break
        return self

    def oriented(self, bits: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> LabelModel:
        """The same with class 1 the one that labels say is toxic."""
        p = self.posterior(bits)
        mean = [np.average(p[toxic == c], weights=counts[toxic == c]) if (toxic == c).any() else 0.5 for c in (0, 1)]
        if mean[1] < mean[0]:
            self.prior, self.rates = 1 - self.prior, self.rates[::-1].copy()
        return self

    def _update(self, bits: np.ndarray, counts: np.ndarray, q: np.ndarray, choose: bool) -> None:
        weight = np.stack([(1 - q) * counts, q * counts])
        self.prior = float(np.clip(weight[1].sum() / counts.sum(), 1e-4, 1 - 1e-4))
        values = np.stack([1 - bits, bits], axis=2)  # of each vote: is it 0, is it 1
        joint = np.stack([np.einsum("r,rja,rkb->jkab", w, values, values, optimize=True) for w in weight]) + 0.1
        total = joint.sum((3, 4), keepdims=True)
        p = joint / total
        one, two = p.sum(4, keepdims=True), p.sum(3, keepdims=True)
        told = (p * np.log(p / (one * two))).sum((3, 4)) * total[..., 0, 0]  # what one vote says of another within a class
        self.correlations = self._correlations(p, weight.sum(1))
        if choose:
            self._choose(told.sum(0) / counts.sum())
        j = np.arange(bits.shape[1])
        up = np.where(self.parent < 0, j, self.parent)
        for c in (0, 1):
            given = joint[c][up, j]  # by the parent's vote and the vote
            alone = joint[c][j, j][:, [0, 1], [0, 1]]
            self.rates[c] = np.where((self.parent < 0)[:, None], (alone[:, 1] / alone.sum(1))[:, None], given[:, :, 1] / given.sum(2))

    def _choose(self, told: np.ndarray) -> None:
        """The forest of the most telling pairs, grown from voter 0."""
        self.parent[:] = -1
        inside, outside = [0], list(range(1, len(told)))
        while outside:
            part = told[np.ix_(inside, outside)]
            i, o = np.unravel_index(part.argmax(), part.shape)
            if part[i, o] >= MIN_TOLD:
                self.parent[outside[o]] = inside[i]
            inside.append(outside.pop(o))

    def _correlations(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Correlations of votes within classes, averaged over them."""
        rate = p[..., 1].sum(3).transpose(0, 2, 1)[:, 0]  # by class and voter
        cov = p[..., 1, 1] - rate[:, :, None] * rate[:, None, :]
        sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
        out = np.average(cov / (sd[:, :, None] * sd[:, None, :]), axis=0, weights=weight)
        np.fill_diagonal(out, 0)
        return out


def bits_of(votes: np.ndarray, voters: int = VOTERS) -> np.ndarray:
    return (votes[:, None] >> np.arange(voters) & 1).astype(float)


def first_guess(bits: np.ndarray) -> np.ndarray:
    """Class 1 by the voters' majority: the more of them speak, and above all the densest, the likelier."""
    return 1 / (1 + np.exp(3 - bits[:, :LEXICONS].sum(1) - bits[:, LEXICONS : LEXICONS + len(DENSITIES)].sum(1)))


class Classifier:
    """Logistic regression on the entries a text has and on what density and pattern voters say."""

    def __init__(self, entries: list[str], weights: np.ndarray):
        self.entries, self.weights = entries, weights

    def scores(self, found: pd.Series, votes: pd.Series) -> np.ndarray:
        k = len(self.entries)
        size = found.map(len).to_numpy()
        own = np.concatenate([np.empty(0, dtype=np.int64), *found]).astype(np.int64)
        z = np.bincount(np.repeat(np.arange(len(found)), size), weights=self.weights[own], minlength=len(found))
        z += bits_of(votes.to_numpy())[:, LEXICONS:] @ self.weights[k : k + FORMS] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_classifier(found: pd.Series, votes: np.ndarray, targets: np.ndarray, entries: list[str], rounds: int = 300, step: float = 0.1, ridge: float = 1e-3) -> Classifier:
    """Fits posterior labels by Adam steps over all rows, with a ridge on all but the bias."""
    k, n = len(entries), len(votes)
    r, c = np.nonzero(bits_of(votes)[:, LEXICONS:])
    row = np.concatenate([np.repeat(np.arange(n), found.map(len)), r])
    col = np.concatenate([np.empty(0, dtype=np.int64), *found, k + c]).astype(np.int64)
    width = k + FORMS
    w, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + w[width]
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - targets
        grad = np.append(np.bincount(col, weights=error[row], minlength=width) / n + ridge * w[:width], error.mean())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w = w - step * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return Classifier(entries, w)


def drawn(share: float, *columns: str) -> Column:
    """Whether a row is of the ``share`` drawn by a hash of its columns, however small that is."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 62)) < F.lit(int(share * (1 << 62)))


def scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_fitted: int = MAX_FITTED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, _file, _row (see ``exact_dedup.located``), held_out, score (0 to 1) and predicted of each row of ``docs``.

    Labels count only from rows outside the held-out fold; null labels and ids are left out, of repeated labels the
    largest counts. At most about ``max_labelled`` labelled texts, drawn by a hash of their ids, make the lexicons, and at
    most about ``max_fitted`` texts, drawn by a hash of theirs, fit the classifier; votes are counted over every text
    outside the held-out fold. Without labels of both kinds, or without an entry, every score is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = located(docs.select("doc_id", "text"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold_of(F.col("doc_id")) != HELD_OUT)
    share = min(1.0, max_labelled / max(1, known.count()))
    known = known.where(drawn(share, "doc_id"))
    labelled = stored(rows.join(known, "doc_id").select("doc_id", "text", "toxic"), "labelled")
    entries = lexicon(labelled)
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    if not entries:
        return rows.select("doc_id", "_file", "_row", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    marks = marked(rows, entries, ["doc_id", "_file", "_row"])
    learnt = marks.where(~held_out)
    counted = learnt.groupBy("votes").count().toPandas()  # at most 2 ** VOTERS rows
    told = learnt.join(known, "doc_id").groupBy("votes", "toxic").count().toPandas()
    bits = bits_of(counted["votes"].to_numpy())
    model = LabelModel(VOTERS).fit(bits, counted["count"].to_numpy(), first_guess(bits))
    model.oriented(bits_of(told["votes"].to_numpy()), told["toxic"].to_numpy(), told["count"].to_numpy())

    share = min(1.0, max_fitted / max(1, int(counted["count"].sum())))
    sample = learnt.where(drawn(share, "doc_id", "_row")).orderBy("doc_id", "_file", "_row").select("found", "votes").toPandas()
    if not len(sample):
        raise ValueError("no text was drawn to fit the classifier on; raise max_fitted")
    classifier = fit_classifier(sample["found"], sample["votes"].to_numpy(), model.posterior(bits_of(sample["votes"].to_numpy())), entries)

    @F.pandas_udf("double")
    def score(found: pd.Series, votes: pd.Series) -> pd.Series:
        return pd.Series(classifier.scores(found, votes))

    out = marks.select("doc_id", "_file", "_row", held_out, score("found", "votes").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _located(docs: DataFrame) -> DataFrame:
    """``docs`` as something whose rows can be located again."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return stored(docs, "docs")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with its columns, held_out, score and predicted (which replace columns of those names).
    Null and empty texts get the score of a text without words, long ones are read whole; null ids are not held out;
    repeated rows are scored alike; an empty table gives no rows."""
    docs = _located(docs)
    added = ("held_out", "score", "predicted")
    file, row = free([*docs.columns, *added], "_file", "_row")
    told = stored(scores(docs, labels).select(F.col("_file").alias(file), F.col("_row").alias(row), *added), "scores")
    return located(docs, file, row).drop(*added).join(told, [file, row]).drop(file, row)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns they have, whatever those are called. Only the
    locators of the rows that go meet the texts again."""
    docs = _located(docs)
    file, row = free(docs.columns, "_file", "_row")
    gone = stored(scores(docs, labels).where("predicted = 1").select(F.col("_file").alias(file), F.col("_row").alias(row)), "toxic")
    return located(docs, file, row).join(gone, [file, row], "left_anti").select(*quoted(docs.columns))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted")
