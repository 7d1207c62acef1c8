"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last 16 bytes hits a pattern, so equal
passages get equal chunks wherever they stand.  A chunk's body runs from its
first to its last ASCII white space.  Bodies that occur in two or more different
texts are encoded once in the whole corpus and shared by a join; all others are
encoded where they stand, with the joins around them.  At each end of a shared
body the words on both sides are encoded together and apart: if the ids differ,
the re-encoded stretch is extended over that body, and so on up to the next body
whose ends agree or the end of the text.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to the empty string; equal texts, repeated rows and null ids each keep
their row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import SPACE, map_rows, mix, pick, prefix_hash

WINDOW = 16
CUT_BITS = 10           # a cut every 1,024 bytes on average
CACHED_WORDS = 300_000  # units kept per task besides those of the text at hand; more only cost time
CACHED_BODIES = 4_000   # shared bodies kept per task
KEYS = "k1 long not null, k2 long not null"  # nullable keys would give inner joins a filter of their own, and so a second exchange of the texts
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the known split pattern
# The same pattern within lower-cased plain Latin letters, digits and signs.
_UNITS = re.compile(r"[a-zÀ-ÖØ-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zÀ-ÖØ-öø-ſ0-9]+")
_PLAIN = re.compile(r"[\t-\r -~¡¿«»À-įı-ňŊ-ſ]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """One tokenizer file: ids as little-endian unsigned 32-bit bytes, and their decoded text.

    With the known split pattern plain Latin texts are split here; units that the
    bounded table lacks are encoded by the tokenizer, all of a text's in one call.
    Every other text, or file, goes to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        names = {i: t for t, i in self.exact.get_vocab(with_added_tokens=True).items()}
        self.names = names.__getitem__
        self.width = "<u2" if max(names, default=0) < 1 << 16 else "<u4"  # narrowest type that holds every id
        self.joins_names = self.exact.decoder is None  # without a decoder, tokens are joined by blanks
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", ())]
        splits = [n.get("pattern", {}).get("Regex") for n in (spec["pre_tokenizer"] or {}).get("pretokenizers", ())]
        self.by_word = self.joins_names and steps == ["NFC", "Replace", "Lowercase"] and splits[:1] == [SPLIT]
        self.ends = np.zeros(max(names, default=0) + 1, dtype=bool)
        self.ends[[i for i, t in names.items() if t.endswith("</w>")]] = True  # fixed value: the file's mark of a unit's last token
        self.unit_ids: dict[str, bytes] = {}
        self.unit_texts: dict[str, str] = {}

    def _ids(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def _learn(self, units: set[str]) -> None:
        """The tables hold all ``units`` afterwards."""
        new = list(units.difference(self.unit_ids))
        if len(self.unit_ids) + len(new) > CACHED_WORDS:
            self.unit_ids.clear()
            self.unit_texts.clear()
            new = list(units)
        found = self._ids(" ".join(new))
        stops = (np.flatnonzero(self.ends[found]) + 1).tolist() if found else []
        if len(stops) != len(new):
            each = [self._ids(u) for u in new]
            found, stops = [i for ids in each for i in ids], np.cumsum([len(ids) for ids in each]).tolist()
        raw, names, start = _bytes(found), list(map(self.names, found)), 0
        for unit, stop in zip(new, stops):
            self.unit_ids[unit], self.unit_texts[unit] = raw[4 * start:4 * stop], " ".join(names[start:stop])
            start = stop

    def encode(self, text: str) -> tuple[bytes, str]:
        if not (self.by_word and _plain(text)):
            ids = self._ids(text)
            return _bytes(ids), self._names(ids)
        units = _UNITS.findall(text.lower())
        self._learn(set(units))
        return b"".join(map(self.unit_ids.__getitem__, units)), " ".join(filter(None, map(self.unit_texts.__getitem__, units)))

    def stored(self, ids: bytes) -> tuple[bytes, str]:
        """The same for ids kept in the narrow type."""
        found = np.frombuffer(ids, dtype=self.width)
        return found.astype("<u4").tobytes(), self._names(found.tolist())

    def _names(self, ids: list[int]) -> str:
        return " ".join(map(self.names, ids)) if self.joins_names else ""

    def whole(self, parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        """Ids and decoded text of neighbouring parts."""
        raw = b"".join([ids for ids, _ in parts])
        if self.joins_names:
            return raw, " ".join([text for _, text in parts if text])
        return raw, self.exact.decode(np.frombuffer(raw, dtype="<u4").tolist(), skip_special_tokens=False)

    def agrees(self, data: bytes, at: int) -> bool:
        """Whether the words on both sides of a place get the same ids together as apart."""
        lo = hi = at
        for blank in (True, False):
            while lo > 0 and SPACE[data[lo - 1]] == blank:
                lo -= 1
            while hi < len(data) and SPACE[data[hi]] == blank:
                hi += 1
        left, right = data[lo:at].decode(), data[at:hi].decode()
        return self._ids(left + right) == self._ids(left) + self._ids(right)


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


codec = functools.lru_cache(maxsize=2)(Codec)


def chunk_parts(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, body start, body end, end) per chunk; a chunk without white space has an empty body at its end."""
    n = len(data)
    arr = np.frombuffer(data, dtype=np.uint8)
    cuts = np.zeros(0, dtype=np.int64)
    if n > WINDOW:
        sums, inverse = prefix_hash(arr)
        h = mix((sums[WINDOW:] - sums[:-WINDOW]) * inverse[: n + 1 - WINDOW])
        cuts = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW
        cuts = cuts[cuts < n]
        cuts = cuts[(arr[cuts] & 0xC0) != 0x80]  # never inside a character
    blank = np.flatnonzero(SPACE[arr])
    edges = [0, *cuts.tolist(), n]
    first = np.searchsorted(blank, edges)
    out = []
    for i in range(len(edges) - 1):
        s, e = edges[i], edges[i + 1]
        lo, hi = first[i], first[i + 1]
        out.append((s, int(blank[lo]), int(blank[hi - 1]) + 1, e) if hi > lo else (s, e, e, e))
    return out


def _two_longs(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class _Texts:
    """Text key and compressed text of each document."""

    def __call__(self, rows):
        press = zstandard.ZstdCompressor(level=3)
        for (text,) in rows:
            data = (text or "").encode()
            yield *_two_longs(data), press.compress(data)


class _DocKeys:
    def __call__(self, rows):
        for doc_id, text in rows:
            yield doc_id, *_two_longs((text or "").encode())


class _Bodies:
    """The distinct chunk bodies of each text, by hash."""

    def __call__(self, rows):
        open_ = zstandard.ZstdDecompressor()
        for k1, k2, z in rows:
            data = open_.decompress(z)
            for h in {_two_longs(data[b:c]) for _, b, c, _ in chunk_parts(data) if c > b}:
                yield *h, k1, k2


class _Owned:
    """Ids of the shared bodies that a text was chosen to encode."""

    def __init__(self, path):
        self.path = path

    def __call__(self, rows):
        open_, tool = zstandard.ZstdDecompressor(), codec(self.path)
        for z, owned in rows:
            data, todo = open_.decompress(z), {(o["h1"], o["h2"]) for o in owned}
            for _, b, c, _ in chunk_parts(data):
                h = _two_longs(data[b:c]) if c > b else None
                if h in todo:
                    todo.discard(h)
                    ids, _ = tool.encode(data[b:c].decode())
                    yield *h, np.frombuffer(ids, dtype="<u4").astype(tool.width).tobytes()


class _Assemble:
    """Ids and decoded text of each text, from shared bodies, own bodies and repaired joins."""

    def __init__(self, path, digests):
        self.path, self.digests = path, digests

    def __call__(self, rows):
        open_, tool = zstandard.ZstdDecompressor(), codec(self.path)
        bodies: dict[tuple[int, int], tuple[bytes, str]] = {}
        for k1, k2, z, shared in rows:
            data = open_.decompress(z)
            have = {(x["h1"], x["h2"]): x["ids"] for x in shared or ()}
            parts = []
            open_from = 0
            for _, b, c, _ in chunk_parts(data) if have else ():
                h = _two_longs(data[b:c]) if c > b else None
                if h not in have or not (tool.agrees(data, b) and tool.agrees(data, c)):
                    continue  # encoded with its neighbours
                if h not in bodies:
                    if len(bodies) >= CACHED_BODIES:
                        bodies.clear()
                    bodies[h] = tool.stored(have[h])
                parts += [tool.encode(data[open_from:b].decode()), bodies[h]]
                open_from = c
            raw, text = tool.whole([*parts, tool.encode(data[open_from:].decode())])
            if self.digests:
                yield k1, k2, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
            else:
                yield k1, k2, raw, text


def encoded_texts(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """One row per different text: its key (k1, k2), ids (little-endian unsigned 32-bit) and decoded text.

    With ``digests`` the ids and the text are replaced by n_tokens and their
    SHA-256 digests, made where the ids are, so that neither is moved.
    """
    path = path or default_path()
    texts = map_rows(pick(docs, "text"), f"{KEYS}, z binary", _Texts()).dropDuplicates(["k1", "k2"])
    # Hashes only, from the exchange of the texts, where copies are already dropped.
    bodies = map_rows(texts, f"h1 long, h2 long, {KEYS}", _Bodies())
    shared = bodies.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2")).alias("o")).filter("n > 1").select("h1", "h2", "o.k1", "o.k2")
    # Joins on the whole key, as below, so that both read one exchange of the texts.
    owners = shared.groupBy("k1", "k2").agg(F.collect_list(F.struct("h1", "h2")).alias("owned"))
    ids = map_rows(texts.join(owners, ["k1", "k2"]).select("z", "owned"), "h1 long, h2 long, ids binary", _Owned(path)).dropDuplicates(["h1", "h2"])
    lists = bodies.join(ids, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("h1", "h2", "ids")).alias("shared"))
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return map_rows(texts.join(lists, ["k1", "k2"], "left").select("k1", "k2", "z", "shared"), f"{KEYS}, {out}", _Assemble(path, digests))


def by_document(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``encoded_texts`` for every document; copies meet one text each."""
    keys = map_rows(pick(docs, "doc_id", "text"), f"doc_id long, {KEYS}", _DocKeys())
    return keys.join(texts, ["k1", "k2"]).drop("k1", "k2")
