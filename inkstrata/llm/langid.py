"""Language identification by cross-parsing entropy.

A suffix automaton is built from a bounded sample of labelled rows per language. A text is parsed against each automaton
from left to right into the longest phrases that occur in that language's sample; fewer phrases mean that the language
explains the text better. Phrases are normalised as code lengths: phrases * log2(sample length) / characters.

The sample of a language is whole rows, those with the smallest hashes: each of the first ROWS that are not longer than what is
left of SAMPLE characters (if all rows are longer than SAMPLE, the shortest one). Most states of an automaton have one way on, which
stands beside the state; states with several have a row of the flat table, over the samples' SYMBOLS most frequent characters. A miss
is stored as the complement of the state that follows from the root, so a step needs no second look. Transitions by all other
characters are few and stand in a sorted list of (state, character).

A text is parsed in blocks side by side, each as if a phrase began with it; then each block's true parse comes in from the block
before, and from the first place where both begin a phrase they are one. So the result is that of one parse of the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, chunks, fresh, small_batches
from .pieces import code_points

#: Characters of sample per language, and rows that a sample is drawn from.
SAMPLE, ROWS = 40_000, 100
BLOCK = 512
#: Symbols with a column in the flat tables; rarer ones are looked up in the sorted lists. This bounds memory, not the alphabet.
SYMBOLS = 96


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """The moves of each state of a sequence's suffix automaton; state 0 is the root."""
    link, longest, moves = [-1], [0], [{}]
    last = 0
    for c in codes.tolist():
        now = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[now] = q
            else:
                twin = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return moves


class Table:
    """An automaton in flat arrays over `size` symbols, of which those below `symbols` have columns.

    States are numbered with those of a table row first; row `dense` stands for all others and misses. The last state is where a
    parse starts and where an unseen symbol leads: every symbol starts a phrase there.
    """

    def __init__(self, codes: np.ndarray, symbols: int, size: int) -> None:
        moves = automaton(codes)
        own = [[(c, t) for c, t in m.items() if c < symbols] for m in moves]
        order = sorted(range(len(moves)), key=lambda s: len(own[s]) < 2)
        name = np.empty(len(moves) + 1, np.int64)
        name[order] = np.arange(len(moves))
        self.start = name[-1] = len(moves)
        self.symbols, self.size, self.dense = symbols, size, sum(len(x) > 1 for x in own)
        #: The state after the root, by symbol.
        self.after = np.full(size, self.start, np.int32)
        for c, t in moves[0].items():
            self.after[c] = name[t]
        table = np.tile(~self.after[:symbols], (self.dense + 1, 1))
        self.only, self.to = np.full(len(moves) + 1, -1, np.int16), np.zeros(len(moves) + 1, np.int32)
        rare = []
        for s, m in enumerate(moves):
            if len(own[s]) > 1:
                for c, t in own[s]:
                    table[name[s], c] = name[t]
            elif own[s]:
                self.only[name[s]], self.to[name[s]] = own[s][0][0], name[own[s][0][1]]
            rare += [(int(name[s]) * size + c, int(name[t])) for c, t in m.items() if c >= symbols]
        rare.sort()
        self.keys, self.next = np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32)
        self.flat = table.reshape(-1)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next state, or ~(state after the root) where a new phrase begins."""
        far = np.flatnonzero(c >= self.symbols) if self.size > self.symbols else ()
        near = np.where(c < self.symbols, c, 0) if len(far) else c
        got = self.flat[np.minimum(state, self.dense) * self.symbols + near]
        got = np.where(self.only[state] == near, self.to[state], got)
        if len(far):
            got[far] = self._rare(state[far], c[far])
        return got

    def _rare(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        got = ~self.after[c]
        # A symbol of the sample follows from the root; any other one misses everywhere.
        held = np.flatnonzero(self.after[c] != self.start)
        if len(held):
            key = state[held].astype(np.int64) * self.size + c[held]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            got[held[found]] = self.next[at[found]]
        return got


class Parser:
    """Automata of all languages over one alphabet; symbol 0 is any character that no sample holds."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        count: dict[str, int] = {}
        for x in samples.values():
            for c in x:
                count[c] = count.get(c, 0) + 1
        ranked = sorted(count, key=lambda c: (-count[c], c))
        alphabet = sorted(ranked[: SYMBOLS - 1]) + sorted(ranked[SYMBOLS - 1 :])
        self.symbols, self.size = min(len(alphabet) + 1, SYMBOLS), len(alphabet) + 1
        self.points = np.array([ord(c) for c in alphabet], np.uint32)
        code = {c: i for i, c in enumerate(alphabet, 1)}
        self.tables = [Table(np.array([code[c] for c in samples[lang]], np.int64), self.symbols, self.size) for lang in self.langs]
        self.bits = [np.log2(max(len(samples[lang]), 2)) for lang in self.langs]

    def code(self) -> np.ndarray:
        lookup = np.zeros(0x110000, np.uint8 if self.size <= 256 else np.int32)
        lookup[self.points] = np.arange(1, self.size)
        return lookup

    def phrases(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """languages x rows: phrases of each row (first, length into codes)."""
        blocks = -(-length // BLOCK)
        row = np.repeat(np.arange(len(first)), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(BLOCK, length[row] - nth * BLOCK)
        # Lanes are blocks, longer ones first; `behind` is the lane of the next block of the row.
        order = np.argsort(-size, kind="stable")
        lane = np.empty(len(order), np.int64)
        lane[order] = np.arange(len(order))
        behind = np.full(len(order), -1)
        inner = np.flatnonzero(nth[1:] > 0)
        behind[lane[inner]] = lane[inner + 1]
        size, row = size[order], row[order]
        most = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(most), side="left")  # lanes longer than t
        spot = first[row] + nth[order] * BLOCK
        text = np.zeros((most, len(size)), codes.dtype)
        for t in range(most):
            text[t, : live[t]] = codes[spot[: live[t]] + t]
        out = np.zeros((len(self.tables), len(first)), np.int64)
        for k, table in enumerate(self.tables):
            state = np.full(len(size), table.start, np.int32)
            begins = np.zeros((most, len(size)), bool)
            for t in range(most):
                n = live[t]
                got = table.step(state[:n], text[t, :n])
                sign = got >> 31
                begins[t, :n] = sign
                state[:n] = got ^ sign
            count = begins.sum(axis=0)
            self._joined(table, text, size, begins, state, count, behind)
            out[k] = np.bincount(row, weights=count, minlength=len(first))
        return out

    @staticmethod
    def _joined(table: Table, text: np.ndarray, size: np.ndarray, begins: np.ndarray, state: np.ndarray, count: np.ndarray, behind: np.ndarray) -> None:
        """Put into count the phrases that begin in each lane when the parse comes in from the lane before."""
        source = np.flatnonzero(behind >= 0)
        while len(source):
            to, now = behind[source], state[source]
            came, again = np.zeros(len(to), np.int64), []
            open_ = np.arange(len(to))
            for t in range(len(text)):
                ended = size[to[open_]] <= t
                if ended.any():
                    again.append(open_[ended])
                    open_ = open_[~ended]
                if not len(open_):
                    break
                got = table.step(now[open_], text[t, to[open_]])
                new = got < 0
                now[open_] = np.where(new, ~got, got)
                met = new & begins[t, to[open_]]
                came[open_] += new & ~met
                done = open_[met]
                # From here on the lane's own parse is the true one.
                count[to[done]] = came[done] + begins[t:, to[done]].sum(axis=0)
                open_ = open_[~met]
            again = np.concatenate([*again, open_]) if again or len(open_) else open_
            # These lanes hold no common place: what they hand on is another state, from which the next lane is parsed again.
            count[to[again]] = came[again]
            state[to[again]] = now[again]
            source = to[again][behind[to[again]] >= 0]


def predictor(parser: Parser):
    """An Arrow UDF text -> struct<lang, score>."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        body, offsets, _ = buffers(text)
        lookup, names, scores = parser.code(), [], []
        for i, j in chunks(offsets):
            points, start = code_points(body[offsets[i] : offsets[j]])
            codes = lookup[points]
            ends = np.searchsorted(start, offsets[i : j + 1] - offsets[i])
            size = np.diff(ends)
            total = parser.phrases(codes, ends[:-1], size)
            cost = total * np.array(parser.bits)[:, None] / np.maximum(size, 1)
            best = np.argmin(cost, axis=0)
            low = cost[best, np.arange(j - i)]
            rest = np.partition(cost, 1, axis=0)[1] if len(cost) > 1 else low * 2
            names += [parser.langs[b] for b in best]
            scores.append(np.where(rest > 0, 1 - low / np.maximum(rest, 1e-12), 0.0))
        score = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], ["lang", "score"])

    return predict


def learn(docs: DataFrame, known: Column) -> Parser | None:
    """A parser from rows where `known` holds; ROWS rows of each language at most come to the driver, each of SAMPLE characters at
    most: a sample for fitting, bounded by the number of languages."""
    text = F.col("text").cast("string")
    rows = docs.where(known & F.col("lang").isNotNull() & F.col("text").isNotNull() & text.rlike(r"\p{L}"))
    over = F.when(F.length(text) > SAMPLE, F.length(text)).otherwise(0)
    ranked = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("h"), over.alias("over"), text.alias("t"), F.spark_partition_id().alias("p"))
    # Ranks are over all labelled rows, in two steps, so that no task gets the least rows of more than the root of all tasks.
    salt = F.col("p") % F.lit(max(1, int(docs.rdd.getNumPartitions() ** 0.5)))
    for key in (["lang", salt], ["lang"]):
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("over", "h", "t"))).where((F.col("n") <= ROWS) & ((F.col("over") == 0) | (F.col("n") == 1)))
    samples: dict[str, str] = {}
    for r in sorted(ranked.select("lang", "n", F.lower("t").alias("t")).collect(), key=lambda r: (r["lang"], r["n"])):
        have = samples.get(r["lang"], "")
        if not have or len(have) + 1 + len(r["t"]) <= SAMPLE:
            samples[r["lang"]] = have + "\n" * bool(have) + r["t"]
    return Parser(samples) if samples else None


def identify(docs: DataFrame, known: Column) -> DataFrame:
    """docs(text, lang, ...) with lang_pred and score; only rows where `known` holds are learned from.

    A text that is null or has no letter is `und` with score 0, as is everything if nothing can be learned. score is the
    relative gap between the best and the second code length (one language only: 0.5). Ties go to the language that sorts
    first. Rows are judged by their text alone, so repeated rows agree; whole texts are parsed. An empty table gives an
    empty result. Extra columns are carried; clashing names get more underscores.
    """
    small_batches(docs.sparkSession)
    lang, score, s = fresh(docs, "lang_pred"), fresh(docs, "score"), fresh(docs, "_found")
    parser = learn(docs, known)
    if parser is None:
        return docs.withColumns({lang: F.lit("und"), score: F.lit(0.0)})
    text = F.col("text").cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn(s, predictor(parser)(F.coalesce(F.lower(text), F.lit(""))))
    return out.withColumns({lang: F.when(letters, F.col(s)["lang"]).otherwise("und"), score: F.when(letters, F.col(s)["score"]).otherwise(0.0)}).drop(s)
