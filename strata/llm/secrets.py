"""Secret scans: pattern matches, and candidates confirmed by their structure.

Base kinds (leftmost matches that do not overlap, per kind): ``assign``, ``access``, ``hex``.
Confirmed kinds are reported only after the candidate was decoded and parsed:

* ``jwt``: a signed token, whose first segment decodes to a JSON object with a string ``alg``,
  whose second decodes to a JSON object, and whose third decodes to bytes (none for ``alg`` none);
* ``pem``: an armoured private key block whose body decodes to a key encoding; an encrypted one to an algorithm and
  encrypted bytes in DER, or, with Proc-Type and DEK-Info headers, to whole blocks of the cipher. Line ends may be
  written as escapes, as in JSON;
* ``der``: base64 (either alphabet) or hexadecimal text that decodes to a private key in DER (PKCS#1, PKCS#8 with the key of its
  algorithm inside, SEC1 or DSA), with every nested length inside its parent and none left over;
* ``sshkey``: base64 or hexadecimal text that decodes to an OpenSSH private key, whose
  length-prefixed fields fill their parents, the public keys' and, where it is not encrypted, the private part's included.

Base64 may be wrapped into lines; a key then ends with the line in which its stated length is reached,
and what follows on the next line is text, or a key of its own. A stated length beyond ``MAX_KEY`` bytes is no key's. Only stated lengths are
decoded, and armour lines are paired in one pass, so that a text takes time in proportion to its length, whatever it holds.

A text that is null counts as empty: no spans. Texts are scanned whole; offsets are code points,
ends exclusive. Very long texts are scanned whole; an empty table gives no rows. Spans that begin at one place go by kind. Equal rows give equal results row by row; extra columns are not read by the scan,
whatever their names, but for ``secret_spans``, which it makes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strata.llm.common import byte_slices, schema_with, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "der", "sshkey")
MASK = "[SECRET]"
BATCH_BYTES = 4 << 20

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A brace and what may follow it in JSON: a quote or white space.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]+)\.(e[wy][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
PEM_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,\\-]*")
PEM_HEADER = re.compile(r"(?m)^[A-Za-z-]+:.*$")
DEK_INFO = re.compile(r"(?m)^DEK-Info: *[A-Z0-9-]+,[0-9A-Fa-f]{16,}\s*$")
#: DER sequences begin with 0x30, in base64 "M"; OpenSSH keys begin with their magic bytes.
B64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-Za-z0-9+/]|b3BlbnNzaC1rZXktdjE)(?:[A-Za-z0-9+/]|\r?\n(?=[A-Za-z0-9+/])){38,}={0,2}")
B64URL = re.compile(r"(?<![A-Za-z0-9_-])M[A-Za-z0-9][A-Za-z0-9_-]{38,}(?![A-Za-z0-9_-])")
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e7373682d6b65792d7631)[0-9A-Fa-f]{78,}", re.IGNORECASE)
B64_LINE = re.compile(r"[A-Za-z0-9+/]+")
#: Bytes beyond which a stated length is no key's: the largest keys in use take a fraction of it.
MAX_KEY = 1 << 16
SSH_MAGIC, SSH_BEGIN = b"openssh-key-v1\0", "b3BlbnNzaC1rZXktdjE"

#: Cheap necessary conditions, so that texts without a candidate skip the patterns.
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
IN_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
IN_B64 = bytes(104 if i in b"+/-_\r\n" or i < 128 and chr(i).isalnum() else 32 for i in range(256))

Span = tuple[int, int, str, int]


def unbase64(text: str, url: bool = False) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, begin and end of each element between two offsets, or None if lengths do not fit exactly."""
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + n > end:
            return None
        items.append((tag, at, at + n))
        at += n
    return items


#: Algorithms of PKCS#8 and the size of the key in an octet string, 0 for those with a structure of their own; fixed values.
ALGORITHMS = {"2a864886f70d010101": 0, "2a8648ce3d0201": 0, "2a8648ce380401": 0, "2b6570": 32, "2b6571": 57, "2b656e": 32, "2b656f": 56}


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and bytes of each field of a sequence that fills the data."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return None
    parts = der_items(data, outer[0][1], outer[0][2])
    return [(tag, data[a:b]) for tag, a, b in parts] if parts else None


def is_inner_key(algorithm: str, data: bytes) -> bool:
    """The key inside PKCS#8, as its algorithm has it; of an unknown one any element that fills the bytes."""
    items = der_items(data, 0, len(data))
    if not items or len(items) != 1:
        return False
    if size := ALGORITHMS.get(algorithm):
        return items[0][0] == 0x04 and items[0][2] - items[0][1] == size
    return is_der_key(data) if algorithm in ("2a864886f70d010101", "2a8648ce3d0201") else items[0][0] == 0x02 if algorithm in ALGORITHMS else True


def is_der_key(data: bytes) -> bool:
    """A private key: an outer sequence that fills the bytes and holds the fields of a known encoding."""
    parts = der_fields(data)
    if not parts or len(parts) < 2 or parts[0][0] != 0x02:
        return False
    version, tags = int.from_bytes(parts[0][1], "big"), [tag for tag, _ in parts]
    if tags[1:] in ([0x02] * 8, [0x02] * 5) and version == 0:  # RSA, DSA
        return True
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:  # PKCS#8
        inner = der_items(parts[1][1], 0, len(parts[1][1]))
        return bool(inner) and inner[0][0] == 0x06 and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]) and is_inner_key(parts[1][1][inner[0][1] : inner[0][2]].hex(), parts[2][1])
    return version == 1 and tags[1] == 0x04 and len(parts[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC1


def is_encrypted_key(data: bytes) -> bool:
    """An algorithm and encrypted bytes: two fields, the first of which begins with the algorithm's identifier."""
    parts = der_fields(data)
    if not parts or [tag for tag, _ in parts] != [0x30, 0x04]:
        return False
    inner = der_items(parts[0][1], 0, len(parts[0][1]))
    return bool(inner) and inner[0][0] == 0x06 and len(parts[1][1]) >= 16 and len(parts[1][1]) % 8 == 0


def der_size(data: bytes) -> int | None:
    """The bytes of the element that begins the data, by its header."""
    if len(data) < 2 or not data[1] & 0x80:
        return 2 + data[1] if len(data) >= 2 else None
    width = data[1] & 0x7F
    return 2 + width + int.from_bytes(data[2 : 2 + width], "big") if 1 <= width <= 4 and len(data) >= 2 + width else None


def ssh_fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill the data."""
    out, at = [], 0
    while at < len(data):
        if at + 4 > len(data) or at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def is_ssh_private(data: bytes, kinds: list[bytes]) -> bool:
    """The private part of keys that are not encrypted: a number twice, the keys' fields and the padding 1, 2, 3, ..."""
    if len(data) % 8 or data[:4] != data[4:8]:
        return False
    for pad in range(16):  # the cipher's block at most
        if data.endswith(bytes(range(1, pad + 1))):
            fields = ssh_fields(data[8 : len(data) - pad])
            if fields and fields[0] == kinds[0] and all(k in fields for k in kinds):
                return True
    return False


def ssh_size(data: bytes) -> int | None:
    """The bytes of the whole OpenSSH private key that begins the data; None if it is no such key."""
    if not data.startswith(SSH_MAGIC):
        return None
    at, number, fields = len(SSH_MAGIC), 1, []
    for part in range(6 + 64):  # cipher, kdf, kdf options, number of keys, public keys, private part
        if part > 4 + number:
            break
        if at + 4 > len(data):
            return None
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if part == 3:
            if not 1 <= n <= 64:
                return None
            number = n
            continue
        if at + n > len(data):
            return None
        fields.append(data[at : at + n])
        at += n
    public = [ssh_fields(f) for f in fields[3:-1]]
    if not all(p and len(p) > 1 and p[0].isascii() for p in public):
        return None
    whole = is_ssh_private(fields[-1], [p[0] for p in public]) if fields[0] == b"none" else len(fields[-1]) >= 16 and len(fields[-1]) % 8 == 0
    return at if whole else None


def is_ssh_key(data: bytes) -> bool:
    return ssh_size(data) == len(data)


def ssh_stated(body: str, at: int) -> int | None:
    """The bytes that the lengths within an OpenSSH key's base64 text, which begins at a character, add up to. Only these are
    decoded; None where they are no key's or lead beyond the text."""
    off, number, most = len(SSH_MAGIC), 1, (len(body) - at) * 3 // 4
    for part in range(6 + 64):  # as in ssh_size
        if part > 4 + number:
            break
        if off + 4 > min(most, MAX_KEY):
            return None
        a = off // 3 * 4
        data = unbase64(body[at + a : at + a + 8])
        if data is None:
            return None
        n, off = int.from_bytes(data[off % 3 : off % 3 + 4], "big"), off + 4
        if part == 3:
            if not 1 <= n <= 64:
                return None
            number = n
        else:
            off += n
    return off if off <= min(most, MAX_KEY) else None


def base64_keys(text: str, begin: int, end: int) -> Iterator[tuple[str, int, int]]:
    """The keys in a run of base64 lines: each begins a line and ends one, at the length that its own header states."""
    lines = [m.span() for m in B64_LINE.finditer(text, begin, end)]
    body = "".join(text[a:b] for a, b in lines)
    ends = list(accumulate(b - a for a, b in lines))  # in body
    chars = lambda size: size // 3 * 4 + (0, 2, 3)[size % 3]
    i = 0
    while i < len(lines):
        at, kind, last = ends[i] - (lines[i][1] - lines[i][0]), None, i
        if body[at] == "M":
            size = der_size(unbase64(body[at : at + 8]) or b"")
            stop = at + chars(size) if size and size <= MAX_KEY else at
            last = bisect_left(ends, stop)
            if last < len(ends) and ends[last] == stop > at and is_der_key(unbase64(body[at:stop]) or b""):
                kind = "der"
        elif body.startswith(SSH_BEGIN, at):
            size = ssh_stated(body, at)
            if size is not None and ssh_size((unbase64(body[at : at + chars(size)]) or b"")[:size]) == size:
                kind, last = "sshkey", bisect_left(ends, min(at + chars(size), len(body)))
        to = 0 if kind is None else end if last == len(lines) - 1 else lines[last][1]
        if to - lines[i][0] >= 40:
            yield (kind, lines[i][0], to)
            i = last
        i += 1


def json_object(data: bytes | None) -> dict | None:
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_jwt(m: re.Match) -> bool:
    head, body, signature = json_object(unbase64(m[1], True)), json_object(unbase64(m[2], True)), unbase64(m[3], True)
    if head is None or body is None or signature is None or not isinstance(head.get("alg"), str):
        return False
    return len(signature) >= 16 or head["alg"].lower() == "none"


def is_pem_key(label: str, body: str) -> bool:
    """Whether an armoured block holds a key of some encoding, encrypted or not."""
    body = re.sub(r"\\+[nr]", "\n", body)
    data = unbase64(PEM_HEADER.sub("", body)) or b""
    if "Proc-Type:" in body:
        return "ENCRYPTED" in body and bool(DEK_INFO.search(body)) and len(data) >= 16 and len(data) % 8 == 0
    return is_encrypted_key(data) if label.startswith("ENCRYPTED") else is_der_key(data) or is_ssh_key(data)


def armoured(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(label, body, begin, end) of the blocks between a BEGIN line and the END line of its label with no other such line between."""
    begin = None
    for m in PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        else:
            if begin is not None and begin[2] == m[2] and PEM_BODY.fullmatch(text, begin.end(), m.start()):
                yield m[2], text[begin.end() : m.start()], begin.start(), m.end()
            begin = None


def confirmed(text: str, long_runs: bool = True) -> Iterator[tuple[str, int, int]]:
    """Spans of the confirmed kinds; ``long_runs``: whether 40 characters of base64 follow one another anywhere."""
    if "." in text and ("ey" in text or "ew" in text):
        yield from (("jwt", *m.span()) for m in JWT.finditer(text) if is_jwt(m))
    if "PRIVATE KEY-----" in text:
        yield from (("pem", a, b) for label, body, a, b in armoured(text) if is_pem_key(label, body))
    if not long_runs:
        return
    for m in B64.finditer(text):
        yield from base64_keys(text, *m.span())
    for m in B64URL.finditer(text) if "-" in text or "_" in text else ():
        if ("-" in m[0] or "_" in m[0]) and is_der_key(unbase64(m[0], True) or b""):
            yield ("der", *m.span())
    for m in HEXKEY.finditer(text):
        data = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else None
        if data and is_der_key(data):
            yield ("der", *m.span())
        elif data and is_ssh_key(data):
            yield ("sshkey", *m.span())


def spans(text: str) -> list[Span]:
    """All spans by start, then kind: start, end, kind, and where the secret value itself begins."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access", m.start()) for m in ACCESS.finditer(text)]
    raw = text.encode(errors="replace")
    if b"h" * 32 in raw.translate(IN_HEX):
        found += [(*m.span(), "hex", m.start()) for m in HEX.finditer(text)]
    found += [(a, b, kind, a) for kind, a, b in confirmed(text, b"h" * 40 in raw.translate(IN_B64))]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in found if k in kinds)


def masked(text: str, found: list[Span], mask: str = MASK) -> str:
    """The text with every secret value replaced; values that overlap are replaced together."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted((v, b) for _, b, _, v in found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, text: str = "text", mask: str | None = None) -> DataFrame:
    """Add ``secret_spans`` (array of kind, begin, end) to every row; with ``mask`` also replace the values in the text.

    Row by row in Arrow batches cut by bytes; other columns pass through unread.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for batch in byte_slices(whole, text, BATCH_BYTES):
                texts = batch.column(text).to_pylist()
                found = [spans(x) if x else [] for x in texts]
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                if mask is not None:
                    columns[text] = pa.array([masked(x, f, mask) if f else x for x, f in zip(texts, found, strict=True)], pa.string())
                columns["secret_spans"] = pa.array([[{"kind": k, "begin": a, "end": b} for a, b, k, _ in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kept = df.drop("secret_spans")
    span = T.StructType().add("kind", T.StringType()).add("begin", T.IntegerType()).add("end", T.IntegerType())
    schema = schema_with(kept, secret_spans=T.ArrayType(span))
    return kept.mapInArrow(scan, schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's digest per document: counts and the hash of the base spans, and all spans."""
    from pyspark.sql import functions as F

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.begin.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s.kind == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s.kind.isin(*BASE))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("secret_spans")).alias("spans"),
    )


def digest(text: str | None) -> str:
    """The hash of the base spans of one text, for tests."""
    return hashlib.sha256(joined(spans(text or ""), BASE).encode()).hexdigest()
