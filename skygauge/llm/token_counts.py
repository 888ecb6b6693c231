"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Which token ends a prefix of a word is unique, and it depends only on what the merges can still reach: the longest
suffix that starts some token, and the tokens that end at the positions inside that suffix. These contexts are the
states of a deterministic transducer. A transition reads one byte and is annotated with the number of tokens it adds
to the count so far (none or less than none where a merge swallows earlier tokens); the sum over a word is its
number of tokens. States and transitions are compiled when a text first needs them and shared by all texts of a
worker, as are the sums of whole words.

Two neighbouring tokens may follow each other exactly if the merges, run on their two texts alone, give these two. The
merges inside a token are run once a token, and what they leave at its edges is kept with the rank that ends it; two
tokens are then compared along their seam, edge by edge. These edges are bounded by the vocabulary.

A text is cut into chunks of `CHUNK` characters, each mapped on its own: words between its first and last white space
are counted, the open pieces at both ends are kept. Ordered by position these maps compose: an open end and the next
open start are one word, whose piece states meet there. The composition is a prefix scan over the chunks of a text;
only texts of several chunks have anything to compose.

Normalisation and pre-tokenizer follow the tokenizer file for this family: special tokens first, then NFC, white space
to one blank, lower case by code point, contractions, letter runs, single digits, runs of the rest. Other settings
are refused. White space never takes part in normalisation, so chunks may end there.

Defined cases: a null or empty text has 0 bytes and 0 tokens; one endless word is one piece; repeated rows count
each; an empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import n_bytes

CHUNK = 1 << 16
LIMIT = 2048
END = "</w>"
NEVER = 1 << 60
#: Most words whose sums a worker keeps, and most states of its transducer; beyond them it starts anew.
MEMO_WORDS = 400_000
MOST_STATES = 50_000
#: The pre-tokenizer's pattern, as in the tokenizer file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK = regex.compile(r"[ \t-\r]")


def load(path: str) -> dict:
    """Tables of the tokenizer file, as plain values that can be broadcast (the file bounds their size)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
    pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    if (model["type"], model["end_of_word_suffix"], steps, pieces) != ("BPE", END, ["NFC", "Replace", "Lowercase"], PIECES):
        raise ValueError("this tokenizer file needs other normalisation or merges than are compiled here")
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    built: dict[str, int] = {}
    for (a, b), rank in ranks.items():
        built[a + b] = rank  # the last merge that builds it
    if any(max(built.get(a, -1), built.get(b, -1)) >= rank for (a, b), rank in ranks.items()):
        raise ValueError("a token is merged before the merges that build it")
    return {
        "vocab": dict.fromkeys(model["vocab"]),
        "ranks": ranks,
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Transducer:
    """Lazily compiled: `steps[state]` maps a symbol to (state, added tokens), `ends[state]` a last symbol to tokens."""

    def __init__(self, vocab: dict, ranks: dict):
        self.vocab, self.ranks = vocab, ranks
        self.starts = {t[:i] for t in (v.removesuffix(END) for v in vocab) for i in range(1, len(t))}
        self.edges: dict = {}
        self.number: dict = {}
        self.states: list = []
        self.steps: list[dict] = []
        self.ends: list[dict] = []
        self._state(("", ((None, 0),)))

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.ends.append({})
        return self.number[key]

    def _begin_anew(self, state: int) -> int:
        """Forget all compiled states but the first one and `state`; its new number."""
        first, key = self.states[0], self.states[state]
        for table in (self.number, self.states, self.steps, self.ends):
            table.clear()  # in place: callers hold them
        self._state(first)
        return self._state(key)

    def _edges(self, token: str) -> tuple[list, list] | None:
        """What stands at the left and the right edge of a token while the merges build it, each with the rank of the
        merge that ends it; None if they build something else. By rank, leftmost first; run once a token."""
        if token not in self.edges:
            body = token.removesuffix(END)
            symbols = list(body)
            symbols[-1] += token[len(body) :]
            left, right = [], []
            while len(symbols) > 1:
                rank, at = min((self.ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
                if rank == NEVER:
                    break
                if at == 0:
                    left.append((symbols[0], rank))
                if at == len(symbols) - 2:
                    right.append((symbols[-1], rank))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            whole = [(token, NEVER)]
            self.edges[token] = (left + whole, right + whole) if symbols == [token] else None
        return self.edges[token]

    def _may_follow(self, left: str | None, right: str) -> bool:
        """No merge over the seam comes before those inside the two tokens (see `load`: ranks grow with the tokens)."""
        after = self._edges(right)
        if left is None or after is None:
            return after is not None
        x, y = iter(self._edges(left)[1]), iter(after[0])
        (a, end_a), (b, end_b) = next(x), next(y)
        while True:
            rank = self.ranks.get((a, b), NEVER)
            if rank < end_a and rank <= end_b:  # of equal merges the left one comes first
                return False
            if end_a == end_b == NEVER:
                return True
            if end_a <= end_b:
                a, end_a = next(x)
            else:
                b, end_b = next(y)

    def _last_token(self, state: int, symbol: str, end: str) -> tuple[str, int]:
        """The token that ends after `symbol`, and the tokens it adds."""
        suffix, window = self.states[state]
        text = suffix + symbol
        for start in range(len(text)):
            token = text[start:] + end
            if token in self.vocab and self._may_follow(window[start][0], token):
                return token, window[start][1] + 1
        raise ValueError(f"no token for {text!r}")

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        found = self.steps[state].get(symbol)
        if found is None:
            token, added = self._last_token(state, symbol, "")
            suffix, window = self.states[state]
            longer = suffix + symbol
            while longer and longer not in self.starts:
                longer = longer[1:]
            kept = window[len(window) - len(longer) :] if longer else ()
            key = (longer, (*((t, n - added) for t, n in kept), (token, 0)))
            if len(self.states) >= MOST_STATES and key not in self.number:
                state = self._begin_anew(state)
            found = self.steps[state][symbol] = (self._state(key), added)
        return found

    def tokens(self, symbols: str) -> int:
        state = total = 0
        steps = self.steps
        for symbol in symbols[:-1]:
            state, added = steps[state].get(symbol) or self.step(state, symbol)
            total += added
        last = symbols[-1]
        if last not in self.ends[state]:
            self.ends[state][last] = self._last_token(state, last, END)[1]
        return total + self.ends[state][last]


class Counter(dict):
    """Tokens of a piece, kept for pieces seen before."""

    def __init__(self, tables: dict):
        super().__init__()
        self.transducer = Transducer(tables["vocab"], tables["ranks"])
        self.bytes = byte_symbols()
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("|".join(map(regex.escape, tables["special"])) or r"(?!)")

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        n = self.transducer.tokens("".join([self.bytes[b] for b in piece.encode()]))
        if len(piece) < 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if "<|" in text else [text]
        total = len(parts) - 1
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # by code point: no final sigma
            total += sum(map(self.__getitem__, self.pieces.findall(part.lower())))
        return total


def _counter(shared: Broadcast) -> Counter:
    tables = shared.value  # one object a worker: the compiled transducer stays with it
    if "counter" not in tables:
        tables["counter"] = Counter(tables)
    return tables["counter"]


def _chunk_map(counter: Counter, chunk: str, first: bool, last: bool) -> tuple[int, str | None, str | None]:
    """(tokens inside, open start, open end); no end and a start: the chunk has no white space at all."""
    if first and last:
        return counter.count(chunk), None, None
    left = _BLANK.search(chunk)
    if left is None:
        return 0, chunk, None
    right = max(chunk.rfind(c) for c in " \t\n\v\f\r")
    return counter.count(chunk[left.start() : right + 1]), chunk[: left.start()], chunk[right + 1 :]


def _mapper(shared: Broadcast):
    @F.pandas_udf("struct<inside:long,head:string,tail:string>")
    def chunk_maps(chunk: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        counter = _counter(shared)
        found = [_chunk_map(counter, *x) for x in zip(chunk, first, last)]
        return pd.DataFrame(found, columns=["inside", "head", "tail"]).astype({"head": object, "tail": object})

    return chunk_maps


def _joiner(shared: Broadcast):
    @F.pandas_udf("long")
    def joined(words: pd.Series) -> pd.Series:
        counter = _counter(shared)
        return pd.Series([0 if w is None else sum(map(counter.count, w)) for w in words], dtype="int64")

    return joined


# prefix scan over the maps of a text: `open` is the word that is still open, `words` those that closed on a seam
_SCAN = """
aggregate(maps, struct('' as open, cast(array() as array<string>) as words), (s, m) ->
  if(m.tail is null, struct(s.open || coalesce(m.head, '') as open, s.words as words),
     struct(m.tail as open, array_append(s.words, s.open || m.head) as words)),
  s -> array_append(s.words, s.open))
"""


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """`docs` without `text`, with `n_bytes`, `n_tokens` and `over_limit` (more than `limit` tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    carried = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"),
        F.monotonically_increasing_id().alias("_id"),
        n_bytes(text).alias("n_bytes"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    last = F.expr(f"greatest(0, (char_length(_text) - 1) div {chunk})")
    chunks = rows.withColumn("_last", last).select(
        "_row",
        "_id",
        "n_bytes",
        "_last",
        F.posexplode(
            F.expr(
                "if(_last = 0, array(_text),"
                f" transform(sequence(0L, _last), i -> substring(_text, cast(i * {chunk} + 1 as int), {chunk})))"
            )
        ).alias("_no", "_chunk"),
    )
    mapped = chunks.select(
        "_row", "_id", "n_bytes", "_last", "_no",
        _mapper(shared)(F.col("_chunk"), F.col("_no") == 0, F.col("_no") == F.col("_last")).alias("m"),
    ).select("_row", "_id", "n_bytes", "_last", "_no", "m.*")
    # one row a text. Sums combine before the shuffle; only open pieces are listed, in order, as many as a text has chunks
    whole = mapped.groupBy("_id").agg(
        F.first("_row").alias("_row"),
        F.first("n_bytes").alias("n_bytes"),
        F.sum("inside").alias("_inside"),
        F.array_sort(
            F.collect_list(F.when(F.col("_last") > 0, F.struct("_no", "head", "tail")))
        ).alias("maps"),
    )
    scanned = whole.withColumn("_words", F.expr(f"if(size(maps) > 0, {_SCAN}, null)"))
    total = F.col("_inside") + _joiner(shared)(F.col("_words"))
    return (
        scanned.withColumn("n_tokens", total)
        .withColumn("over_limit", F.col("n_tokens") > limit)
        .select("_row.*", "n_bytes", "n_tokens", "over_limit")
    )
