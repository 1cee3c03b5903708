"""Quality rules as a short-circuit cascade.

Every text gets its base figures. Those that the base rule keeps go through the cascade: each rule looks only at the texts that all
rules before it kept. Each task measures every rule's seconds and share of rejected texts on a sample, the first texts that it reads and
the base rule keeps, and puts the rules in the order of rejections per second for the rest of its texts. So no text is read twice, the
order fits the part of the data at hand, and a task that is run again needs nothing from elsewhere. The order decides what is computed,
never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix, span_hashes, text_pieces, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True


@dataclass
class Texts:
    """The bytes of some texts, one after the other, and where each begins."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Of each text, the bytes for which the mask holds."""
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def pick(self, rows: np.ndarray) -> Texts:
        parts = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in rows]
        return Texts(np.concatenate(parts) if parts else self.data[:0], np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(self.data, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines, and the text of each."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate((self.offsets[:-1], breaks + 1)))
        of = np.repeat(np.arange(len(self)), self.count(self.data == 10) + 1)
        first = np.concatenate((np.flatnonzero(np.diff(of, prepend=-1)), [len(of)]))
        ends = np.concatenate((starts[1:] - 1, [len(self.data)]))
        ends[first[1:] - 1] = self.offsets[1:]
        return starts, ends, of


def _salted(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(of.astype(np.uint64) + np.uint64(1)))


def duplicate_lines(t: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    starts, ends, of = t.lines()
    word_starts, _, _ = t.words()
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, of = starts[filled], ends[filled], of[filled]
    _, first = np.unique(_salted(span_hashes(t.data, starts, ends), of), return_index=True)
    return np.bincount(of, minlength=len(t)) - np.bincount(of[first], minlength=len(t))


def repeated_words(t: Texts, window: int = 3) -> np.ndarray:
    """Words that lie in a window of words which is found twice or more in their text."""
    starts, ends, first = t.words()
    of = np.repeat(np.arange(len(t)), np.diff(first))
    n = len(starts) - window + 1
    if n <= 0:
        return np.zeros(len(t), np.int64)
    hashes = span_hashes(t.data, starts, ends)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n + k]
    inside = of[:n] == of[window - 1 :]
    at = np.flatnonzero(inside)
    _, back, counts = np.unique(_salted(rolled[at], of[at]), return_inverse=True, return_counts=True)
    again = at[counts[back] > 1]
    covered = np.zeros(len(starts), bool)
    for k in range(window):
        covered[again + k] = True
    return np.bincount(of[covered], minlength=len(t))


def word_chars(t: Texts) -> np.ndarray:
    """Code points in words."""
    return t.count(((t.data & 0xC0) != 0x80) & (t.data != 0x20) & ((t.data < 9) | (t.data > 13)))


def base_figures(t: Texts) -> dict[str, np.ndarray]:
    n = np.diff(t.words()[2])
    return {"n_words": n, "word_chars": word_chars(t), "n_symbols": t.count(SYMBOLS[t.data]), "n_dup_lines": duplicate_lines(t), "n_repeat_words": repeated_words(t)}


def base_fails(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes texts and the base figures of these and says which of them go."""

    name: str
    rejects: Callable[[Texts, dict[str, np.ndarray]], np.ndarray]


def _mean_length(t: Texts, b: dict) -> np.ndarray:
    return (b["word_chars"] < 2 * b["n_words"]) | (b["word_chars"] > 15 * b["n_words"])


def _symbols(t: Texts, b: dict) -> np.ndarray:
    return 10 * b["n_symbols"] > b["n_words"]


def _same_lines(t: Texts, b: dict) -> np.ndarray:
    """Three lines or more, and over 30 % of the lines that aren't empty, are repeats."""
    starts, ends, of = t.lines()
    return (b["n_dup_lines"] > 2) & (10 * b["n_dup_lines"] > 3 * np.bincount(of[ends > starts], minlength=len(t)))


def _capitals(t: Texts, b: dict) -> np.ndarray:
    letters = t.count(_LETTER[t.data])
    return 10 * t.count(_UPPER[t.data]) > 6 * np.maximum(letters, 1)


def _exclaims(t: Texts, b: dict) -> np.ndarray:
    """Over a third of the words end in two exclamation marks."""
    starts, ends, first = t.words()
    shout = (ends - starts > 1) & (t.data[ends - 1] == 33) & (t.data[ends - 2] == 33)
    total = np.concatenate(([0], np.cumsum(shout)))
    return 3 * (total[first[1:]] - total[first[:-1]]) > b["n_words"]


def _one_word(t: Texts, b: dict) -> np.ndarray:
    """One word makes up over 30 % of the words."""
    starts, ends, first = t.words()
    of = np.repeat(np.arange(len(t)), np.diff(first))
    most = np.zeros(len(t), np.int64)
    if len(starts):
        _, at, counts = np.unique(_salted(span_hashes(t.data, starts, ends), of), return_index=True, return_counts=True)
        np.maximum.at(most, of[at], counts)
    return 10 * most > 3 * b["n_words"]


def _few_letters(t: Texts, b: dict) -> np.ndarray:
    """Under half of the code points in words are letters (all code points beyond ASCII count as such)."""
    letters = t.count(_LETTER[t.data]) + t.count(t.data >= 0xC0)
    return 2 * letters < b["word_chars"]


RULES = (
    Rule("mean_length", _mean_length),
    Rule("symbols", _symbols),
    Rule("same_lines", _same_lines),
    Rule("capitals", _capitals),
    Rule("exclaims", _exclaims),
    Rule("one_word", _one_word),
    Rule("few_letters", _few_letters),
)


class Cascade:
    """The rules in the order of rejections per second, once ``sample`` texts are measured; until then every rule sees every text."""

    def __init__(self, rules: Iterable[Rule], sample: int = 500) -> None:
        self.rules, self.sample, self.seen = list(rules), sample, 0
        self.gone = {r.name: 0 for r in self.rules}
        self.seconds = {r.name: 0.0 for r in self.rules}

    def measure(self, t: Texts, base: dict[str, np.ndarray]) -> np.ndarray:
        """Which of these texts go; each rule's seconds and rejections are counted, and the order is made from all counts so far."""
        out = np.zeros(len(t), bool)
        for rule in self.rules:
            began = time.perf_counter()
            gone = rule.rejects(t, base)
            self.seconds[rule.name] += time.perf_counter() - began
            self.gone[rule.name] += int(gone.sum())
            out |= gone
        self.seen += len(t)
        self.rules.sort(key=lambda r: (-self.gone[r.name] / max(self.seconds[r.name], 1e-9), self.seconds[r.name]))
        return out

    def kept(self, t: Texts, base: dict[str, np.ndarray]) -> np.ndarray:
        """Which texts the base rule and all others keep; a rule sees only what is left."""
        left = np.flatnonzero(~base_fails(base["n_words"], base["n_repeat_words"]))
        part = lambda: (t.pick(left), {k: v[left] for k, v in base.items()}) if len(left) < len(t) else (t, base)
        kept = np.zeros(len(t), bool)
        if len(left) and self.seen < self.sample:
            left = left[~self.measure(*part())]
        else:
            for rule in self.rules:
                if not len(left):
                    break
                left = left[~rule.rejects(*part())]
        kept[left] = True
        return kept


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, carry: Sequence[str] = (), sample: int = 500) -> DataFrame:
    """doc_id, the columns named in ``carry``, the base figures, base_failed and kept of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have no words, fail the base rule and are not kept. Rows that repeat a doc_id are each answered, as are rows
    without one. An empty table gives an empty result; a very long text is one row like any other. ``order`` names the rules in the order
    of evaluation; by default each task measures it, in rejections by second of wall time, on the first ``sample`` texts that the base rule
    leaves: the order changes the cost, never a verdict. Columns that are named as the result's can't be carried along.
    """
    taken = {"doc_id", "base_failed", "kept", *FIGURES} & set(carry)
    if taken:
        raise ValueError(f"columns of the result can't be carried along: {sorted(taken)}")
    by_name = {r.name: r for r in rules}

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules, sample) if order is None else Cascade([by_name[n] for n in order], 0)
        for batch in batches:
            for i, j, data, offsets in text_pieces(batch.column("text")) if batch.num_rows else ():
                t = Texts(data, offsets)
                base = base_figures(t)
                failed = base_fails(base["n_words"], base["n_repeat_words"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(i, j - i) for n in ("doc_id", *carry)), *(pa.array(base[n].astype(np.int64)) for n in FIGURES), pa.array(failed), pa.array(cascade.kept(t, base))],
                    names=["doc_id", *carry, *FIGURES, "base_failed", "kept"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(n for n in carry if n != "text"))
    kinds = dict(docs.dtypes)
    carried = "".join(f"`{n}` {kinds[n]}, " for n in carry)
    return docs.mapInArrow(of, f"doc_id long, {carried}" + ", ".join(f"{n} long" for n in FIGURES) + ", base_failed boolean, kept boolean")


#: The same for DuckDB, written from the rules' statements.
ORACLE_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws, string_split(t, chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
w AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w) GROUP BY doc_id),
f AS (SELECT doc_id, t, ws, ls, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS filled,
      len(filled) - len(list_distinct(filled)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(most, 0) AS most,
      length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
      length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) AS beyond
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN w USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR n_repeat_words > 0.5 * n_words AS base_failed,
       NOT (base_failed OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words OR n_symbols > 0.1 * n_words
            OR (n_dup_lines >= 3 AND n_dup_lines > 0.3 * len(list_filter(ls, lambda x: x <> '')))
            OR upper > 0.6 * greatest(letters, 1) OR len(list_filter(ws, lambda w: suffix(w, '!!'))) > n_words / 3 OR most > 0.3 * n_words
            OR letters + beyond < 0.5 * word_chars) AS kept
FROM f
"""
