"""BPE encoding and decoding by dynamic programming over prefixes (operator 2).

For every prefix of a pre-token exactly one vocabulary token can be the last one of the prefix's encoding.  An automaton with suffix
links reports all tokens that end at a position; the one that is right is compatible with the last token of the
prefix before it: encoding the two tokens' text together gives just these two.  Following the back-pointers from the
end gives the ids.  Work is linear in the text, whatever the length of a pre-token.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.durable import trim

#: Entries of one generation of a cache of pre-token codes, and of the caches of pairs and steps; longer pre-tokens are not kept.
#: They bound memory (two generations of some 230 bytes an entry) and do not alter results.
PIECES, PAIRS, LONGEST = 160_000, 200_000, 32
#: Texts that are Python strings at one time.
ROWS = 256


def _printable() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 bytes are themselves, others follow from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cache(dict):
    """A dict that computes what it lacks, bounded by two generations: what is used again outlives the older one."""

    def __init__(self, make, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        if (out := self.old.get(key)) is None:
            out = self.make(key)
            if self.longest and len(key) > self.longest:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Codec:
    """Encodes and decodes as the byte-level BPE tokenizer described by a tokenizers JSON file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _printable()
        vocab = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.text: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in [*vocab.items(), *((t.encode(), i) for t, i in added.items())]:
            self.text[i] = t
        self.name = [str(i) for i in range(len(self.text))]
        self.added = added
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pattern = regex.compile(pattern)
        # nodes: 0-255 the bytes, then the merges in order; a node's number is its priority
        self.id = [vocab[bytes([b])] for b in range(256)]
        self.length, node = [1] * 256, {bytes([b]): b for b in range(256)}
        self.first, self.second = array("i", range(256)), array("i", range(256))  # the two nodes that a node joins
        self.joined: dict[int, int] = {}
        for left, right in merges:
            a, b = bytes(byte[c] for c in left), bytes(byte[c] for c in right)
            if a + b in node or a not in node or b not in node:
                continue
            self.joined[node[a] << 20 | node[b]] = node[a + b] = len(self.id)
            self.id.append(vocab[a + b])
            self.length.append(len(a) + len(b))
            self.first.append(node[a])
            self.second.append(node[b])
        self._automaton(node)
        self.fits = Cache(self._fits, PAIRS)
        self.lead = Cache(lambda word: self._piece(" " + word), PIECES, LONGEST)
        self.bare = Cache(self._piece, PIECES // 2, LONGEST)

    def _automaton(self, node: dict[bytes, int]) -> None:
        """States are the prefixes of tokens; suffix links give, for each state, the tokens that end there, longest first."""
        self.goto: dict[int, int] = {}
        byte, parent, own = [0], [0], [-1]
        for t, n in node.items():
            at = 0
            for b in t:
                if (to := self.goto.get(at << 8 | b)) is None:
                    to = self.goto[at << 8 | b] = len(own)
                    byte.append(b)
                    parent.append(at)
                    own.append(-1)
                at = to
            own[at] = n
        self.link, self.ending = [0] * len(own), [()] * len(own)
        depth = [0] * len(own)
        for s in range(1, len(own)):  # a state's parent has a smaller number
            depth[s] = depth[parent[s]] + 1
        for s in sorted(range(1, len(own)), key=depth.__getitem__):
            if parent[s]:
                at = self.link[parent[s]]
                while (to := self.goto.get(at << 8 | byte[s])) is None and at:
                    at = self.link[at]
                self.link[s] = to or 0
            self.ending[s] = (((own[s], self.length[own[s]]),) if own[s] >= 0 else ()) + self.ending[self.link[s]]
        self.step = Cache(self._step, PAIRS)

    def _step(self, key: int) -> int:
        state, b = key >> 8, key & 255
        while (to := self.goto.get(state << 8 | b)) is None:
            state = self.link[state]
        return to

    def _fits(self, pair: int) -> bool:
        """Whether merging the two nodes' text, undone step by step from the latest merge, never crosses the border between them."""
        left, right = pair >> 20, pair & 0xFFFFF
        limit = len(self.id)
        while True:
            over = self.joined.get(left << 20 | right, limit)
            if over < limit:  # this merge comes before those that build the two sides
                return False
            # undo the later of the two merges; on a tie the left side was completed first
            if left > right:
                if left < 256:
                    return True
                limit, left = left, self.second[left]
            else:
                if right < 256:
                    return True
                limit, right = right + 1, self.first[right]

    def nodes(self, raw: bytes) -> list[int]:
        """The nodes of the encoding of one pre-token."""
        length, fits, step, ending = self.length, self.fits, self.step, self.ending
        last, state = [0], 0
        for end, b in enumerate(raw, 1):
            state = step[state << 8 | b]
            for node, size in ending[state]:
                if size == end or fits[last[end - size] << 20 | node]:
                    last.append(node)
                    break
        out, at = [], len(raw)
        while at:
            out.append(node := last[at])
            at -= length[node]
        out.reverse()
        return out

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a stretch of text between safe borders."""
        word = piece[1:] if piece[0] == " " else piece
        tokens = [piece] if word.isalpha() else self.pattern.findall(piece)
        if len(tokens) > 1:
            return tuple(chain.from_iterable([self.bare[t] for t in tokens]))
        ids = self.id
        return tuple([ids[n] for n in self.nodes(piece.encode())])

    def codes(self, text: str) -> Iterator[int]:
        """Cuts before single spaces and around single newlines between visible characters, where no pre-token crosses, and codes what
        is between; a text with other white space goes through the pattern as a whole."""
        lines = [line.split(" ") for line in text.split("\n")]
        if list(chain.from_iterable(lines)) != text.split():
            return chain.from_iterable(map(self.bare.__getitem__, self.pattern.findall(text)))
        out = []
        for first, *rest in lines:
            out += [self.bare["\n"], self.bare[first], *map(self.lead.__getitem__, rest)]
        return chain.from_iterable(out[1:])

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; strings of added tokens become their ids."""
        out: list[int] = []
        for part, special in self.parts(text):
            out += [self.added[part]] if special else self.codes(part)
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the text decoded from the ids."""
        ids = self.encode(text)
        raw = self.decode_bytes(ids)
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return len(ids), hashlib.sha256(",".join(map(self.name.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a Python worker, file and pattern."""
    if (path, pattern) not in _CODECS:
        trim()
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids` array<int>. Null text counts as empty and gives an empty array; all rows and other columns stay (a column named
    `ids` is replaced)."""

    @F.arrow_udf("array<int>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in it:
            yield pa.array([c.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn(ids, run(F.coalesce(F.col(text), F.lit(""))))


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds `text`, decoded from array<int> `ids` (null: empty); bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for lists in it:
            yield pa.array([c.decode(x or []) for x in lists.to_pylist()], pa.string())

    return df.withColumn(text, run(F.col(ids)))


def bpe_digest(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, then decodes the ids, and returns a digest of both a row: key, n_tokens, ids_sha256, decoded_sha256. Repeated rows and
    null keys stay as they are; null text counts as empty. Texts of any length are handled whole."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in chain.from_iterable((whole.slice(i, ROWS) for i in range(0, len(whole), ROWS)) for whole in it):
            n, a, b = zip(*[c.digest(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", key)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digest(docs, str(tokenizers.path("byte_bpe_50k.json")), tokenizers.PATTERN)
