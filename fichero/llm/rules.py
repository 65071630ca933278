"""Operator 3: quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the
counts of vote patterns estimates how often each rule votes what on good and on bad documents, without
labels; a document's posterior probability of being good then decides, instead of "all rules must pass".

With R rules there are at most 3^R patterns, whatever the corpus (RULES has 9: 19,683). Only that table of
counts, of proven size, reaches the driver; votes are counted over all documents.

Null and empty texts have no words: they fail the base test. Repeated rows are judged alike. Very long texts
are counted whole. Columns other than key and text are not read, so their names do not matter. Posteriors equal
to the threshold keep a document. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Scratch, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_NOT_UPPER = re.compile(r"[^A-ZÀ-ÖØ-Þ]+")
SYMBOLS = "#*$%&|<>"


def _plain_end(word: str) -> bool:
    return word[-1].isalnum() or (len(word) > 1 and word[-2].isalnum() and word[-1] in ".,;:?!)\"'»”’")


def measure(text: str | None) -> dict[str, int]:
    """Counts over a whole text; words are runs of other than ASCII white space."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x and x.strip(SPACE_CHARS)]
    upper = len(_NOT_UPPER.sub("", text)) if text else 0
    chars = sum(map(len, words))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": _in_repeats(words),
        "n_lines": len(lines), "n_upper": upper, "n_distinct": len(set(words)), "n_lettered": sum(map(str.isalpha, (w[0] for w in words))), "n_shouts": text.count("!!"), "n_plain_ends": sum(map(_plain_end, words)),
    }


def _in_repeats(words: list[str]) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n - 2:
        return 0
    number: dict[tuple, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, n - 2)
    twice = np.bincount(ids)[ids] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def _between(value: Callable[[pd.DataFrame], pd.Series], good: float, bad: float) -> Callable[[pd.DataFrame], np.ndarray]:
    """Votes good up to `good` (from it on, if good > bad), bad beyond `bad`, abstains between."""
    sign = 1 if good < bad else -1

    def votes(x: pd.DataFrame) -> np.ndarray:
        v = sign * value(x)
        return np.where(v <= sign * good, 1, np.where(v > sign * bad, -1, 0))

    return votes


def _share(a: str, b: str) -> Callable[[pd.DataFrame], pd.Series]:
    return lambda x: x[a] / x[b].clip(lower=1)


#: Name and votes of each rule, over a frame of `measure`'s counts.
RULES: dict[str, Callable[[pd.DataFrame], np.ndarray]] = {
    "few_symbols": _between(_share("n_symbols", "word_chars"), 0.02, 0.08),
    "usual_word_length": _between(lambda x: (x["word_chars"] / x["n_words"].clip(lower=1) - 6).abs(), 3, 5),
    "few_equal_lines": lambda x: np.where(x["n_lines"] < 5, 0, _between(_share("n_dup_lines", "n_lines"), 0.3, 0.6)(x)),
    "few_repeats": _between(_share("n_repeat_words", "n_words"), 0.1, 0.3),
    "few_capitals": _between(_share("n_upper", "word_chars"), 0.15, 0.4),
    "many_distinct_words": lambda x: np.where(x["n_words"] < 50, 0, _between(_share("n_distinct", "n_words"), 0.15, 0.05)(x)),
    "words_begin_with_letters": _between(_share("n_lettered", "n_words"), 0.9, 0.75),
    "words_end_plainly": _between(_share("n_plain_ends", "n_words"), 0.85, 0.7),
    "no_shouting": _between(_share("n_shouts", "n_words"), 0.02, 0.15),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def vote(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the base counts, base_failed and `pattern` (one character + - 0 per rule) for every row."""
    schema = f"key {docs.schema[key].dataType.simpleString()}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, pattern string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = pd.DataFrame.from_records([measure(t) for t in batch["text"]]) if len(batch) else pd.DataFrame(columns=[*measure("")], dtype="int64")
            votes = np.stack([np.asarray(f(counts)) for f in RULES.values()], 1).reshape(len(counts), len(RULES))
            out = counts[[*BASE]].copy()
            out.insert(0, "key", batch["key"].to_numpy(dtype=object) if batch["key"].isna().any() else batch["key"].to_numpy())
            out["base_failed"] = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            out["pattern"] = ["".join("-0+"[v + 1] for v in row) for row in votes]
            yield out

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, schema).withColumnRenamed("key", key)


def estimate(patterns: dict[str, int], rounds: int = 200, prior_share: float = 0.02, found: float = 0.25, false: float = 0.01) -> dict[str, float]:
    """Posterior of "good" for each vote pattern, by expectation-maximisation.

    Rules are taken as independent given the quality. Defects differ, so a rule is expected to see one in a share
    `found` of the bad documents and wrongly in `false` of the good; that belief keeps the weight of prior_share of
    the documents. A rule's odds never turn against its own vote, so "good" stays good.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    votes = np.array([["-0+".index(c) for c in p] for p in names])
    counts = np.array([patterns[p] for p in names], float)
    total, n_rules = counts.sum(), votes.shape[1]
    hot = np.eye(3)[votes]  # pattern, rule, vote
    silent = (counts[:, None] * hot[:, :, 1]).sum(0) / total
    belief = np.empty((2, n_rules, 3))  # quality, rule, vote
    for y, bad in ((0, found), (1, false)):
        belief[y] = np.stack([(1 - silent) * bad, silent, (1 - silent) * (1 - bad)], 1)
    table_, good = belief.copy(), 0.7
    least = 1 / (total + 2)  # either kind is possible, however rare
    strength = max(1.0, prior_share * total)
    for _ in range(rounds):
        logs = np.einsum("prv,yrv->py", hot, np.log(np.clip(table_, 1e-9, 1)))
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1] + np.log((1 - good) / good), -700, 700)))
        new = np.empty_like(table_)
        for y, w in ((0, counts * (1 - post)), (1, counts * post)):
            seen = np.einsum("p,prv->rv", w, hot) + strength * belief[y]
            new[y] = seen / seen.sum(1, keepdims=True)
        for v, y in ((0, 0), (2, 1)):  # a vote speaks for what it says, or for nothing
            against = new[y, :, v] < new[1 - y, :, v]
            mean = (new[0, :, v] + new[1, :, v]) / 2
            new[:, against, v] = mean[against]
        new /= new.sum(2, keepdims=True)
        moved, table_ = np.abs(new - table_).max(), new
        good = float(np.clip((counts * post).sum() / total, least, 1 - least))
        if moved < 1e-9:
            break
    return dict(zip(names, map(float, post)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, base counts, base_failed, pattern, quality (posterior) and kept for every row of docs."""
    spark = docs.sparkSession
    voted = Scratch(spark).write(vote(docs, key, text))
    counted = voted.filter("not base_failed").groupBy("pattern").count().collect()  # 3^R rows at most
    posterior = estimate({r["pattern"]: r["count"] for r in counted})
    known = spark.createDataFrame([(k, v) for k, v in posterior.items()], "pattern string, quality double")
    out = voted.join(F.broadcast(known), "pattern", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).select(key, *BASE, "base_failed", "pattern", "quality", "kept")


def op3_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
