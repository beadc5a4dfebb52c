"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can end its encoding. An automaton reports, at each position, all
vocabulary tokens that end there; a candidate is the last token if the piece before it has an encoding whose own last
token is compatible with it, that is, if the two stay apart when their joined text is merged. The last tokens are kept
as back-pointers, and following them from the end gives the ids that the merge procedure would give.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydf.llm import common
from quarrydf.llm.automaton import WIDTH, Automaton

#: Stands for the end-of-word suffix inside the automaton; a private-use character that byte-level text never holds.
_END = "\ue000"
_NEVER = 1 << 60
#: Entries of each half of a worker's caches, and the longest text that they keep: their memory is bounded.
CACHE, CACHED_CHARS = 150_000, 48
#: Texts that are held as Python objects at once.
TEXTS = 256

#: Texts of these characters alone need no library to clean and cut them: no character composes with its neighbour, each
#: has one lower-case form, and letters, digits and the rest are told apart by the pattern below.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\u00c0-\u00ff\u0152\u0153\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac\u00ab\u00bb\u00bf\u00a1]*")
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0153"
_PLAIN_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
#: The cleaning and cutting that this shortcut stands for; other files go through the library.
_PLAIN_FOR = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 as it is, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class _Halves:
    """A bounded cache of two halves: when the young half is full it becomes the old one, and what is still used moves back."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class PrefixBpe:
    """A tokenizer file with a BPE model, encoding by the prefix table."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("needs a BPE model without dropout, subword prefix or byte fallback")
        self.suffix = model.get("end_of_word_suffix") or ""
        self._spec, self._library = spec, None
        self.added = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in parsed["added_tokens"]):
            raise ValueError("added tokens must be matched as they are")
        if any(c.isspace() for x in self.added for c in x):
            raise ValueError("added tokens must not hold white space")
        vocab = model["vocab"]
        self._length: dict[int, int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self._merge[left, right] = (rank, whole)
            self._parts.setdefault(whole, (left, right, rank))
        #: For each token, whether it is compatible with tokens after it, as far as asked.
        self._apart: dict[int, dict[int, bool]] = {i: {} for i in vocab.values()}
        self._asked = 0
        self._chunks, self._pieces = _Halves(CACHE // 4), _Halves(CACHE)
        self._letters = _byte_letters()
        self._is_plain = (parsed["normalizer"], parsed["pre_tokenizer"]) == _PLAIN_FOR
        usable = []
        for token, i in vocab.items():
            text = token[: -len(self.suffix)] + _END if self.suffix and token.endswith(self.suffix) and token != self.suffix else token
            symbols = len(text) - text.endswith(_END)
            if i in self._parts:
                left, right, rank = self._parts[i]
                if self._crossing(left, right) != rank:
                    continue  # merging never ends in this token
            elif symbols != 1:
                continue
            self._length[i] = len(text)
            usable.append((text, (i, len(text))))
        self._automaton = Automaton(usable)
        #: The prefix table of the piece encoded last: its text, and by prefix length the automaton's state and the last token.
        self._prefix, self._states, self._last = "", [0], [None]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token`` while it is built, each with the rank of the merge that ends it."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self._parts:
                return out[::-1]
            left, right, until = self._parts[token]
            token = right if side else left

    def _crossing(self, a: int, b: int) -> int:
        """The rank of the merge that joins text of ``a`` with text of ``b`` when both are merged side by side; ``_NEVER`` if none."""
        lefts, rights = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = lefts[i], rights[j]
            rank = self._merge.get((x, y), (_NEVER, 0))[0]
            # of equal pairs the one further left goes first
            if rank < x_until and rank <= y_until and rank != _NEVER:
                return rank
            if x_until == y_until == _NEVER:
                return _NEVER
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two tokens gives the two tokens again."""
        known = self._apart[a].get(b)
        if known is None:
            self._asked += 1
            if self._asked > 2 * CACHE:
                self._asked = 1
                for x in self._apart.values():
                    x.clear()
            known = self._apart[a][b] = self._crossing(a, b) == _NEVER
        return known

    def piece(self, text: str) -> list[int]:
        """The ids of one piece (no further cutting). What it has in common with the start of the piece before is not done again."""
        states, last, length = self._states, self._last, self._length
        n, before = len(text), self._prefix
        same = 0
        for x, y in zip(text, before):
            if x != y:
                break
            same += 1
        inner = n
        if self.suffix:
            text += _END
            # the last character and the end mark are one symbol: no token ends between them
            inner = n - 1
            n += 1
        same = min(same, inner, len(last) - 1)
        del states[same + 1 :], last[same + 1 :]
        self._prefix = text[:inner]
        apart, automaton = self._apart, self._automaton
        step, fail, hits = automaton.step, automaton.fail, automaton.hits
        state = states[same]
        for end in range(same + 1, n + 1):
            c = ord(text[end - 1])
            while (found := step.get(state * WIDTH + c)) is None:
                if not state:
                    found = 0
                    break
                state = fail[state]
            state, best = found, None
            if end <= inner or end == n:
                for token, size in hits[state]:
                    if size != end:
                        left = last[end - size]
                        if left is None:
                            continue
                        fits = apart[left].get(token)
                        if fits is None:
                            fits = self.compatible(left, token)
                        if not fits:
                            continue
                    best = token
                    break
            states.append(state)
            last.append(best)
        out, at = [], n
        while at:
            token = last[at]
            if token is None:
                raise ValueError(f"the vocabulary has no encoding of {text!r}")
            out.append(token)
            at -= length[token]
        del states[inner + 1 :], last[inner + 1 :]
        return out[::-1]

    def _plain(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            # it cleans and cuts what is not plain; merging is always done here
            self._library = Tokenizer.from_str(self._spec)
        clean, cut = self._library.normalizer, self._library.pre_tokenizer
        text = clean.normalize_str(text) if clean else text
        out: list[int] = []
        for part, _ in cut.pre_tokenize_str(text) if cut else [(text, None)]:
            if part:
                out += self.piece(part)
        return out

    def _chunk(self, text: str) -> list[int]:
        """The ids of a text without white space; added tokens in it are taken as such, leftmost and longest first."""
        out: list[int] = []
        while text:
            hit = min(((at, -len(x), x) for x in self.added if (at := text.find(x)) >= 0), default=None)
            if hit is None:
                return out + self._plain(text)
            out += self._plain(text[: hit[0]])
            out.append(self.added[hit[2]])
            text = text[hit[0] + len(hit[2]) :]
        return out

    def _fill(self, parts: set[str], found: dict[str, bytes]) -> None:
        """Put the ids of plain parts into ``found``; those that are not kept are encoded in order, neighbours sharing their start."""
        kept, new = self._pieces, []
        for part in parts:
            ids = kept.young.get(part) or kept.get(part)
            if ids is None:
                new.append(part)
            else:
                found[part] = ids
        new.sort()
        for part in new:
            ids = found[part] = np.array(self.piece(part if part.isascii() else part.encode().decode("latin-1").translate(self._letters)), np.int32).tobytes()
            if len(part) <= CACHED_CHARS:
                kept.put(part, ids)

    def _chunks_into(self, text: str, out: bytearray) -> None:
        """Space, tab and line ends always separate pieces, so what lies between is encoded once and kept."""
        for chunk in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if chunk:
                ids = self._chunks.get(chunk)
                if ids is None:
                    ids = np.array(self._chunk(chunk), np.int32).tobytes()
                    if len(chunk) <= CACHED_CHARS:
                        self._chunks.put(chunk, ids)
                out += ids

    def encode_all(self, texts: list[str], out: bytearray, ends: list[int]) -> None:
        """Append the ids of some texts, four bytes each, and after each the number of ids so far."""
        cut = [_PLAIN_CUT.findall(t.lower()) if self._is_plain and _PLAIN.fullmatch(t) and not any(x in t for x in self.added) else None for t in texts]
        found: dict[str, bytes] = {}
        self._fill(set().union(*[parts for parts in cut if parts]), found)
        for text, parts in zip(texts, cut):
            if parts is None:
                self._chunks_into(text, out)
            else:
                out += b"".join(map(found.__getitem__, parts))
            ends.append(len(out) // 4)

    def encode(self, text: str) -> list[int]:
        out = bytearray()
        self.encode_all([text], out, [])
        return np.frombuffer(out, np.int32).tolist()


class TokenTexts:
    """The text of every token, for decoding by a file without a decoder."""

    def __init__(self, spec: str):
        texts = _token_texts(spec)
        self.size = max(texts) + 1
        self.known = np.zeros(self.size, bool)
        self.texts = np.full(self.size, "", object)
        for i, t in texts.items():
            self.known[i], self.texts[i] = True, t

    def decode(self, ids: np.ndarray) -> str:
        """The texts of the known ids, joined by spaces."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        return " ".join(self.texts[ids[self.known[ids]]].tolist())


#: By digest of the file: one tokenizer, and one table of token texts, for each worker.
_loaded: dict[str, PrefixBpe] = {}
_texts: dict[str, TokenTexts] = {}


def _once(kept: dict, key: str, make):
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def _token_texts(spec: str) -> dict[int, str]:
    parsed = json.loads(spec)
    return {i: t for t, i in parsed["model"]["vocab"].items()} | {x["id"]: x["content"] for x in parsed["added_tokens"]}


def _broadcast(df: DataFrame, path: str, max_bytes: int):
    """(broadcast file, its digest, the file)."""
    common.ship(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > max_bytes:
        raise ValueError(f"{path} has {len(spec)} characters; at most {max_bytes} are broadcast")
    return df.sparkSession.sparkContext.broadcast(spec), hashlib.sha256(spec.encode()).hexdigest(), spec


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with the column ``ids`` (array of int): the encoding of ``text`` without special tokens added.

    ``path`` is a tokenizers JSON file, read on the driver and broadcast (refused beyond ``max_bytes``). Row by row, no
    shuffle; whole texts of any length. Null and empty texts give an empty array; a column named ``ids`` is replaced.
    White space is dropped by the file's pre-tokenizer, which the file must have if it is to match its library.
    """
    spec, key, _ = _broadcast(df, path, max_bytes)

    def run(texts: pa.Array) -> pa.Array:
        tokenizer, out, ends = _once(_loaded, key, lambda: PrefixBpe(spec.value)), bytearray(), [0]
        for at in range(0, len(texts), TEXTS):
            tokenizer.encode_all([t or "" for t in texts.slice(at, TEXTS).to_pylist()], out, ends)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(out, np.int32)))

    return df.withColumn(ids, F.arrow_udf(run, "array<int>")(common.text_of(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with the column ``text``: the library's decoding of ``ids``, special tokens included, for a file without decoder.

    Null arrays give an empty text; null or unknown ids are passed over, as the library does. A column named ``text`` is replaced.
    """
    spec, key, raw = _broadcast(df, path, max_bytes)
    if json.loads(raw)["decoder"] is not None:
        raise ValueError(f"{path} has a decoder of its own")

    def run(rows: pa.Array) -> pa.Array:
        table = _once(_texts, key, lambda: TokenTexts(spec.value))
        ids = rows.values.fill_null(-1).to_numpy(zero_copy_only=False)
        ends = rows.offsets.to_numpy()
        done = [pa.array([table.decode(ids[a:b]) for a, b in zip(ends[at : at + TEXTS], ends[at + 1 : at + TEXTS + 1])], pa.string()) for at in range(0, len(rows), TEXTS)]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return df.withColumn(text, F.arrow_udf(run, "string")(F.col(f"`{ids}`").cast("array<int>")))


def encode_and_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with ``ids`` and ``decoded`` in place of ``text``: what :func:`encode` and :func:`decode` give, in one pass.

    A plan that uses a decoded column beside its ids would encode twice. Rows leave in batches of ``TEXTS``. Columns named
    like the results are replaced.
    """
    spec, key, raw = _broadcast(df, path, max_bytes)
    if json.loads(raw)["decoder"] is not None:
        raise ValueError(f"{path} has a decoder of its own")
    others = [c for c in df.columns if c.lower() not in (text.lower(), ids.lower(), decoded.lower())]
    rows = df.select(*[F.col(f"`{c}`") for c in others], common.text_of(text).alias(text))

    def run(batches):
        tokenizer, table = _once(_loaded, key, lambda: PrefixBpe(spec.value)), _once(_texts, key, lambda: TokenTexts(spec.value))
        for batch in common.slices(batches, TEXTS):
            out, ends = bytearray(), [0]
            tokenizer.encode_all([t or "" for t in batch.column(len(others)).to_pylist()], out, ends)
            flat = np.frombuffer(out, np.int32)
            words = pa.array([table.decode(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], found, words], [*others, ids, decoded])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[F.col(f"`{c}`") for c in others]).schema)
    return rows.mapInArrow(run, f"{kept}{', ' if kept else ''}`{ids}` array<int>, `{decoded}` string")


def digests(both: DataFrame) -> list:
    """Columns of the digests: number of ids, SHA-256 of the ids in decimal joined by spaces, SHA-256 of the decoded text."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op1_bpe(spark, sf_dir):
    """Encode and decode every text of ``documents``; digests of the ids and of the decoded text."""
    import public_tokenizers

    docs = common.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    both = encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return both.select("doc_id", *digests(both))
