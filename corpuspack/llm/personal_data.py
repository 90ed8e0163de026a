"""Operator 12: personal data by patterns and by a character-level bidirectional LSTM with CRF transitions.

The base finds e-mail addresses, IP addresses, card and phone numbers by the contract's patterns. The tagger
(``tagger.py``) learns them as spans of characters from windows of the corpus: the base's spans where they
stand (cards whatever their check digit), the same spans in other writings (``VARIANTS``: an address with ``[at]``, a phone number without its
country, ...), and windows with digits that hold none. It then reads the corpus in overlapping windows;
emissions of a character are averaged over its windows, nearer to a window's middle counting more, and one
Viterbi pass over each stretch of overlapping windows settles all spans together.

A span must hold a digit or an address sign (``TRIGGER``), so windows further than ``MARGIN`` characters from
any of these cannot hold a part of one and are not decoded. What the tagger finds must also be able to be of its kind
(``plausible``) and must not touch a base span; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.tagger import Tagger, spans_of
from corpuspack.session import materialize

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
MARGIN = 64
#: Windows that the tagger learns from: at most this many around spans of each kind, and as many without one.
SAMPLE = 160
#: Optimiser steps.
STEPS = 280
#: Windows that go through the network together.
BATCH = 256
TRIGGER = re.compile(r"[0-9@]|\[at\]|\(at\)")

# The contract's patterns. The look-behind and the possessive counts only keep them linear.
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _byte_part(text: str) -> bool:
    text = text.lstrip("0")
    return len(text) < 4 and int(text or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign's longest local part that no earlier match has taken, and the host behind the sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        else:
            done = at + 1  # a local part cannot hold the sign
        at = text.find("@", max(done, at + 1))


def base_spans(text: str, checked: bool = True) -> list[tuple[int, int, int]]:
    """``kind, start, end`` in code points, by kind and start. Without ``checked``, numbers of a card's length count
    as cards whatever their check digit: that is what a card looks like, and all that characters can teach."""
    if not text:
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte_part, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and (luhn(digits) or not checked):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def plausible(kind: int, text: str) -> bool:
    """Whether a found text can be of its kind at all."""
    digits = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"\S+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(?:(?:\.|\[\.\]|\[dot\]|\(dot\))[A-Za-z0-9-]+)+", text))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(map(_byte_part, parts)) and not re.search(r"[^0-9.()\[\] ]", text)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ._/-]", text)
    return 10 <= len(digits) <= 15 and not re.search(r"[^0-9 .()/+-]", text)


# --------------------------------------------------------------------------- symbols and windows

# Symbols: 0 behind the text, 1 digits, 2 capitals, 3 other letters, 4 line ends, 5 anything else; the other
# printable characters of ASCII have one of their own.
N_SYMBOLS = 6 + 0x7F - 0x20
_SYMBOL = np.full(128, 5, dtype=np.int64)
_SYMBOL[0x20:0x7F] = np.arange(6, 6 + 0x7F - 0x20)
_SYMBOL[0x30:0x3A], _SYMBOL[0x41:0x5B], _SYMBOL[0x0A] = 1, 2, 4


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where(code < 128, _SYMBOL[np.minimum(code, 127)], np.where(code >= 0xC0, 3, 5))


def window_numbers(text: str) -> np.ndarray:
    """The windows (``STRIDE`` apart) that may hold a part of a span, ascending."""
    at = np.array([m.start() for m in TRIGGER.finditer(text)], dtype=np.int64)
    if not len(at):
        return at
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    low = np.maximum(0, (at - MARGIN - WINDOW) // STRIDE + 1)
    high = np.minimum(last, (at + MARGIN) // STRIDE)
    return np.unique(np.concatenate([np.minimum(low + k, high) for k in range(int((high - low).max()) + 1)]))


def tag_windows(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text."""
    coded = [symbols(t) for t in texts]
    numbers = [window_numbers(t) for t in texts]
    jobs = [(i, int(j)) for i, own in enumerate(numbers) for j in own]
    stretches: list[tuple[int, int, np.ndarray]] = []  # text, first character, emissions
    sums: dict[int, list] = {}
    shape = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    for i, own in enumerate(numbers):  # one pair of sums for each stretch of overlapping windows
        cuts = np.flatnonzero(np.diff(own) > WINDOW // STRIDE) + 1
        sums[i] = [(int(p[0]) * STRIDE, np.zeros((int(p[-1] - p[0]) * STRIDE + WINDOW, len(tagger.allowed)), np.float32),
                    np.zeros((int(p[-1] - p[0]) * STRIDE + WINDOW, 1), np.float32)) for p in np.split(own, cuts) if len(p)]
    for a in range(0, len(jobs), BATCH):
        part = jobs[a : a + BATCH]
        codes = np.zeros((len(part), WINDOW), np.int64)
        for r, (i, j) in enumerate(part):
            own = coded[i][j * STRIDE : j * STRIDE + WINDOW]
            codes[r, : len(own)] = own
        scores = tagger.emissions(codes)
        for r, (i, j) in enumerate(part):
            starts = [s[0] for s in sums[i]]
            start, total, weight = sums[i][bisect_left(starts, j * STRIDE + 1) - 1]
            at = j * STRIDE - start
            total[at : at + WINDOW] += scores[r] * shape
            weight[at : at + WINDOW] += shape
    for i in range(len(texts)):
        for start, total, weight in sums[i]:
            n = min(len(total), len(texts[i]) - start)
            stretches.append((i, start, total[:n] / np.maximum(weight[:n], 1.0)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, start, _), tags in zip(stretches, tagger.decode([s[2] for s in stretches])):
        found[i] += [(k, start + a, start + b) for k, a, b in spans_of(tags)]
    return found


def added_spans(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tagger's spans, trimmed, that can be of their kind and touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for kind, a, b in tagged:
        while a < b and text[a] in " \n\t.,;:-":
            a += 1
        while b > a and text[b - 1] in " \n\t.,;:-(":
            b -= 1
        k = bisect_left(taken, (a, a))
        free = (k == len(taken) or taken[k][0] >= b) and (k == 0 or max(e for _, e in taken[max(0, k - 4) : k]) <= a)
        whole = not ((a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()))
        if a < b and free and whole and plausible(kind, text[a:b]):
            out.append((kind, a, b))
    return out


# --------------------------------------------------------------------------- training

def variants(kind: int, text: str) -> list[str]:
    """Other writings of a span."""
    d = _digits(text)
    if kind == 0:
        local, _, host = text.partition("@")
        return [f"{local}[at]{host}", f"{local}(at){host.replace('.', '(dot)')}", f"{local} [at] {host.replace('.', '[.]')}", f"{local}@{host.replace('.', '[.]')}"]
    if kind == 1:
        return [text.replace(".", "[.]"), text.replace(".", "(.)"), text.replace(".", " . ")]
    if kind == 2:
        parts = [d[i : i + 4] for i in range(0, len(d), 4)]
        return [sep.join(parts) for sep in (".", "_", "/")]
    if len(d) < 10:
        return []
    land, a, b, c = d[:-10], d[-10:-7], d[-7:-4], d[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{land or 1} {a} {b} {c}", f"{a} {b} {c}"]


EXAMPLE = "key long, kind int, window string, spans array<int>"


def _examples(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, list[int]]]:
    """Labelled windows of a text: one around each base span, and one around each digit run outside all of them."""
    def window(kind: int, middle: int):
        key = hashlib.blake2b(text[max(0, middle - 40) : middle + 40].encode("utf-8", "surrogatepass"), digest_size=8, key=b"%d" % (kind + 1)).digest()
        key = int.from_bytes(key, "little", signed=True)
        start = max(0, middle - 16 - key % (WINDOW - 48))
        own = text[start : start + WINDOW]
        inside = [(k, max(a, start) - start, min(b, start + WINDOW) - start) for k, a, b in base if a < start + WINDOW and b > start]
        return key, kind, own, [x for s in inside for x in s]

    for kind, a, b in base:
        yield window(kind, (a + b) // 2)
    taken = sorted((a, b) for _, a, b in base)
    for m in re.finditer(r"[0-9][^\s]*", text):
        k = bisect_left(taken, (m.start(), m.start()))
        if (k == len(taken) or taken[k][0] >= m.end()) and (k == 0 or taken[k - 1][1] <= m.start()):
            yield window(len(KINDS), m.start())


def _smallest(kept: list[dict], row: tuple) -> None:
    """Keep the ``SAMPLE`` smallest keys of each kind; equal windows have equal keys and count once."""
    own = kept[row[1]]
    if row[0] in own or (len(own) > SAMPLE and row[0] >= own["max"]):
        return
    own[row[0]] = row
    if len(own) > 2 * SAMPLE:
        keys = sorted(k for k in own if k != "max")[:SAMPLE]
        rows = [own[k] for k in keys]
        own.clear()
        own.update({r[0]: r for r in rows})
    own["max"] = max(k for k in own if k != "max") if len(own) >= SAMPLE else 0


def training_windows(docs: DataFrame) -> list:
    """A bounded sample of labelled windows by a hash: every task offers its smallest, a few tasks choose among them."""
    names = [f.split()[0] for f in EXAMPLE.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()))

    def choose(rows: Iterator[tuple]) -> pa.RecordBatch:
        kept: list[dict] = [{} for _ in range(len(KINDS) + 1)]
        for row in rows:
            _smallest(kept, row)
        best = [own[k] for own in kept for k in sorted(k for k in own if k != "max")[:SAMPLE]]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in best], k) for j, k in enumerate(kinds)], names=names)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (batch.column(0)[i].as_py() for batch in batches for i in range(batch.num_rows))
        yield choose(row for text in texts if text for row in _examples(text, base_spans(text, checked=False)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield choose(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))

    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    offered = materialize(texts.mapInArrow(offer, EXAMPLE), "personal-data-windows")
    chosen = offered.repartition(16, "key").mapInArrow(again, EXAMPLE).collect()  # at most 16 * 5 * SAMPLE windows
    kept: list[dict] = [{} for _ in range(len(KINDS) + 1)]
    for r in sorted(tuple(r) for r in chosen):
        _smallest(kept, r)
    return [own[k] for own in kept for k in sorted(k for k in own if k != "max")[:SAMPLE]]


def _coded(window: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, tags = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    own = symbols(window[:WINDOW])
    code[: len(own)] = own
    for k, a, b in spans:
        if a < min(b, WINDOW):
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
    return code, tags


def train(windows: list, steps: int = STEPS) -> Tagger | None:
    """The tagger of labelled windows (``EXAMPLE`` rows); none without a span to learn from."""
    rows, rng = [], np.random.default_rng(5)
    for _, kind, window, flat in windows:
        spans = [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
        rows.append(_coded(window, spans))
        if kind == len(KINDS):
            continue
        own = [s for s in spans if s[0] == kind and 0 < s[1] and s[2] < len(window)]
        alone = [s for s in own if all(t == s or t[2] <= s[1] or t[1] >= s[2] for t in spans)]
        for _, a, b in alone[:1]:
            for new in variants(kind, window[a:b]):
                if rng.random() < 0.6:
                    grown = len(new) - (b - a)
                    moved = [(k, x, y) if y <= a else (k, x + grown, y + grown) for k, x, y in spans if (k, x, y) != (kind, a, b)]
                    rows.append(_coded(window[:a] + new + window[b:], [*moved, (kind, a, a + len(new))]))
    if not any(t.any() for _, t in rows):
        return None
    tagger = Tagger.fresh(N_SYMBOLS, len(KINDS))
    tagger.fit(np.stack([c for c, _ in rows]), np.stack([t for _, t in rows]), steps=steps)
    return tagger


# --------------------------------------------------------------------------- the operator

RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, tagger: Tagger | None = None, steps: int = STEPS) -> DataFrame:
    """The columns of ``RESULT`` for each row of ``docs``: base counts, the digest of the base spans, all spans.

    Without ``tagger`` one is trained on the documents themselves. Where these hold no base span there is nothing
    to learn, and only the (empty) base is returned. A null or empty text holds nothing. A null ``doc_id`` stays;
    repeated rows give their rows again; other columns are ignored; an empty table gives no rows. Texts are
    read whole, and no row is moved.
    """
    if tagger is None:
        tagger = train(training_windows(docs), steps)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        kinds = (*[pa.int64()] * 5, pa.string(), pa.string())

        def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
            base = [base_spans(t) for t in texts]
            digits = [i for i, t in enumerate(texts) if tagger is not None and TRIGGER.search(t)]
            extra: list[list] = [[] for _ in texts]
            for i, tagged in zip(digits, tag_windows(tagger, [texts[i] for i in digits]) if digits else []):
                extra[i] = added_spans(texts[i], base[i], tagged)
            rows = []
            for i, doc_id in enumerate(ids):
                counts = [sum(k == kind for k, _, _ in base[i]) for kind in range(len(KINDS))]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base[i]).encode()).hexdigest(), joined(base[i] + extra[i])))
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[i].as_py() or ""
                if texts and held + len(text) > 1 << 21:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield flush(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, RESULT)
