"""Quality rules by weak supervision.

Each rule looks at surface counts of a text and votes good (+1), bad (-1) or abstains (0). The votes of all
documents are counted by pattern; expectation-maximisation over those counts estimates, without labels, how often
good documents and each kind of bad ones draw each vote from each rule (a rule's accuracy), and the posterior probability
of quality weighs the votes of a document by them: a vote for bad can be outweighed. A text that fails the base limits goes whatever the posterior.

Rules, all per word unless named otherwise. All vote bad or abstain, but for two that can also vote good:
    symbols          [#*$%&|<>] characters       bad > 0.20
    shouting         upper-case among A-Z a-z letters   bad > 0.50
    bangs            '!' characters              bad > 0.30
    bare             words that hold no letter or digit   bad > 0.20
    repetition       words in repeated 3-word windows   bad > 0.40
    repeated_lines   of the lines with a word    bad > 0.50
    word_length      code points                 bad < 2 or > 14   good 2.5 to 9
    sentences        words ending in . ! ?       bad: none in 40 words or more   good 0.01 to 0.4
A rule votes good only on texts of 50 words or more; on fewer its rates say little.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import WHITE, Scratch, map_rows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bangs", "n_ends", "n_bare")
UPPER, LETTER = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
END = re.compile(rb"[.!?](?=[\x20\x09-\x0D]|\Z)")
BARE = re.compile(rb"(?:(?<=[\x20\x09-\x0D])|\A)[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+(?=[\x20\x09-\x0D]|\Z)")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows whose words occur at two places or more."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered, upto = 0, 0
    for at, gram in enumerate(grams):
        if gram in often:
            covered += at + 3 - max(at, upto)
            upto = at + 3
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text; all zero for null or empty ones."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    without = len(raw.translate(None, LETTER))
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(raw) - without, len(raw) - len(raw.translate(None, UPPER)), raw.count(b"!"), len(END.findall(raw)), len(BARE.findall(raw)),
    )


def measures(texts: list) -> list[list]:
    return [list(x) for x in zip(*map(measure, texts))] or [[] for _ in MEASURES]


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules over the MEASURES columns; all abstain on a text without words."""
    c, words = F.col, F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    enough = c("n_words") >= MIN_WORDS
    rate = lambda name: c(name) / words
    length, ends = rate("word_chars"), rate("n_ends")
    return {
        "symbols": _vote(rate("n_symbols") > 0.2),
        "shouting": _vote(c("n_upper") / F.greatest(c("n_letters"), F.lit(1)) > 0.5),
        "bangs": _vote(rate("n_bangs") > 0.3),
        "bare": _vote(rate("n_bare") > 0.2),
        "repetition": _vote(rate("n_repeat_words") > 0.4),
        "repeated_lines": _vote(c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)) > 0.5),
        "word_length": _vote(enough & ((length < 2) | (length > 14)), enough & length.between(2.5, 9)),
        "sentences": _vote((c("n_ends") == 0) & (c("n_words") >= 40), enough & ends.between(0.01, 0.4)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 1000, smooth: float = 1.0, share: float = 0.25) -> list[tuple[float, list[dict[int, float]]]]:
    """EM over (votes, count): for each kind of bad text the log-odds against good before any vote, and what each rule's vote adds.

    A mixture of good texts and one kind of bad text for each rule that votes bad anywhere; a text of a kind fails the rule of that
    name, all other votes are independent given the kind, and an abstention is an outcome of its own. Each rule's rates are estimated
    in every class, so a text that fails one rule but else votes like good texts and unlike that kind is taken for good. The one
    assumption: a prior on the rates in good texts, as heavy as 30 and ``share`` of all texts that drew no vote for bad. It is a share so
    that the verdict does not change when the corpus grows. No documents, or no votes for bad: no kinds.
    """
    if not patterns:
        return []
    cast, counts = np.array([v for v, _ in patterns]), np.array([n for _, n in patterns], float)
    width, total = cast.shape[1], counts.sum()
    kinds = [j for j in range(width) if (cast[:, j] == -1).any()]
    drawn = (cast[:, :, None] == np.array([-1, 0, 1])).astype(float)
    failed = (cast[:, kinds] == -1).astype(float)
    many = failed.sum(axis=1, keepdims=True)
    belief = np.hstack([np.where(many > 0, 0.1, 1.0), 0.9 * failed / np.maximum(many, 1)])
    prior = np.full((len(kinds) + 1, width, 3), smooth)
    prior[0, :, 1:] += (30 + share * total) / 2
    for _ in range(rounds):
        held = belief * counts[:, None]
        rates = np.einsum("pc,pjv->cjv", held, drawn) + prior
        odds = np.log(rates / rates.sum(axis=2, keepdims=True))
        for c, k in enumerate(kinds, 1):
            odds[c, k] = (0.0, -1e9, -1e9)
        start = np.log((held.sum(axis=0) + smooth) / (total + smooth * (len(kinds) + 1)))
        score = start + np.einsum("pjv,cjv->pc", drawn, odds)
        new = np.exp(score - score.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved, belief = np.abs(new - belief).max(), new
        if moved < 1e-9:
            break
    return [(float(start[c] - start[0]), [dict(zip((-1, 0, 1), map(float, odds[c, j] - odds[0, j]), strict=True)) for j in range(width)]) for c in range(1, len(kinds) + 1)]


def with_measures(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    return map_rows(docs, text, [(m, T.LongType()) for m in MEASURES], measures, carry)


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality_probability, and kept. Runs one count over ``measured`` (at most 3^8 vote patterns reach the
    driver, whatever the input), so that should be a written table."""
    rules = votes()
    voted = measured.withColumns({f"__{k}": v.cast("int") for k, v in rules.items()})
    counted = voted.groupBy(*[f"__{k}" for k in rules]).count().collect()
    against = F.lit(0.0)
    for start, weights in estimate(sorted((tuple(r[:-1]), r[-1]) for r in counted)):
        score = F.lit(start)
        for k, w in zip(rules, weights, strict=True):
            score = score + F.when(F.col(f"__{k}") == 1, w[1]).when(F.col(f"__{k}") == -1, w[-1]).otherwise(w[0])
        against = against + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), score)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = voted.withColumn("base_failed", failed).withColumn("quality_probability", 1 / (1 + against)).drop(*[f"__{k}" for k in rules])
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, quality_probability and kept of every row.

    Null and empty texts have no words, so base_failed. A null doc_id stays null, repeated rows are judged alike, other
    columns are ignored, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    return judge(scratch.keep(with_measures(docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__t")), "__t", ["__id"]))).withColumnRenamed("__id", doc_id)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs that stay, unchanged."""
    scratch = scratch or Scratch(docs.sparkSession, "rules-keep")
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    at = names.index(text)
    measured = scratch.keep(with_measures(plain.withColumn("__t", F.col(f"d{at}")), "__t", [f"d{i}" for i in range(len(names))]))
    return judge(measured, threshold).where("kept").select(*[F.col(f"d{i}").alias(n) for i, n in enumerate(names)])
