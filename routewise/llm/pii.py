"""PII: format-preserving Feistel pseudonyms.

Values are found in the whole text, validated (card numbers by the Luhn sum,
IBANs by their remainder, address octets, phone and social-security ranges,
calendar dates) and replaced by a keyed permutation within their own format:
the free symbols of a value form one number below ``size`` and an alternating
Feistel network with cycle walking permutes ``0 .. size - 1``; check digits are
computed anew.  Equal values get equal pseudonyms in every document, and
``decrypt=True`` restores the text.  Numbers that do not validate stay.  A
candidate that does not validate is tried at each of its shorter ends, the
longest first, and as the kinds that follow; then the search goes on one symbol
after its start, so values beside or inside it are found too.  A pseudonym that
would let an overlapping failed candidate validate is permuted once more, so
that decryption finds the same values.

Kinds: email, secret (value of a token/password/key assignment), card, iban,
ipv4, phone, ssn, date.

Defined results: null stays null with count 0, empty stays empty; every match
in a text of any length is replaced; repeated rows get equal results; extra
columns are kept by the caller's ``keep`` list, which never clashes because
outputs replace inputs of the same name.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, tidy

ship(__name__)

ROUNDS = 10
#: Key of the permutation; pass your own from a secret store.
DEFAULT_KEY = b"routewise-demo-key"

_LETTERS = string.ascii_lowercase
_FIND = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?<![A-Za-z])(?:[Tt]oken|[Pp]assword|passwd|[Ss]ecret|api[_-]?key|API[_-]?KEY)[\"']?[ ]?[=:][ ]?[\"']?(?P<secret>[0-9a-zA-Z_-]{6,})(?![\w-])"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\w/-]|\.\d))"
    r"|(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))"
    r"|(?P<phone>(?<![\w+.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\w-]|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30}(?!\w|\.\d))", re.ASCII)
#: Kinds that may fail, in the order of their alternatives, each by itself.
_ONE = {k: re.compile(p, re.ASCII) for k, p in re.findall(r"\|\(\?P<(ipv4|ssn|card|phone|iban)>(.*?)\)(?=\|\(\?P<|$)", _FIND.pattern)}
#: Length of an IBAN by country.
_IBAN_SIZE = {c: int(n) for c, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 "
    "FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 "
    "LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 "
    "RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20").split())}
_HINT = re.compile(r"[0-9@=:]")
_HEX = re.compile(r"[0-9a-f]+")
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


def _walk(value: int, size: int, tweak: str, key: bytes, back: bool) -> int:
    """Keyed permutation of ``0 .. size - 1``: Feistel rounds over two halves of
    the next even bit width, walked until the value is in range again."""
    if size < 2:
        return value
    bits = max(2, (size - 1).bit_length())
    half = (bits + 1) // 2
    mask = (1 << half) - 1
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    wide = (half + 7) // 8

    def mix(r: int, x: int) -> int:
        d = hashlib.blake2b(x.to_bytes(wide, "little") + bytes([r]) + tweak.encode(), key=key[:64], digest_size=min(64, wide)).digest()
        while len(d) < wide:
            d += hashlib.blake2b(d, key=key[:64]).digest()
        return int.from_bytes(d[:wide], "little") & mask

    while True:
        left, right = value >> half, value & mask
        for r in order:
            if back:
                left, right = right ^ mix(r, left), left
            else:
                left, right = right, left ^ mix(r, right)
        value = (left << half) | right
        if value < size:
            return value


def _symbols(text: str, tweak: str, key: bytes, back: bool) -> str:
    """Permute the ASCII letters and digits of ``text`` within their classes; the rest stays."""
    value, size, sets = 0, 1, []
    for c in text:
        s = string.digits if c in string.digits else _LETTERS if c in _LETTERS else _LETTERS.upper() if "A" <= c <= "Z" else None
        sets.append(s)
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)
    value = _walk(value, size, tweak + "".join(" " if s is None else s[0] for s in sets), key, back)
    out = []
    for c, s in zip(reversed(text), reversed(sets)):
        if s:
            value, k = divmod(value, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """Sum of the digits by Luhn's rule; 0 modulo 10 for a valid number."""
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))


def _secret(v, key, back):
    """Hexadecimal values stay hexadecimal; others are walked on until they are not."""
    if _HEX.fullmatch(v):
        n = _walk(int(v, 16), 16 ** len(v), f"hex{len(v)}", key, back)
        return f"{n:0{len(v)}x}"
    while True:
        v = _symbols(v, "secret", key, back)
        if not _HEX.fullmatch(v):
            return v


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _card(v, key, back):
    d = re.sub(r"\D", "", v)
    if _luhn(d) % 10 or len(set(d)) == 1:
        return None
    body = f"{_walk(int(d[:-1]), 10 ** (len(d) - 1), f'card{len(d)}', key, back):0{len(d) - 1}d}"
    out = body + str(-_luhn(body + "0") % 10)
    return _refill(v, out)


def _iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))


def _iban(v, key, back):
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or len(s) != _IBAN_SIZE.get(s[:2], len(s)) or _iban_number(s) % 97 != 1:
        return None
    body = _symbols(s[4:], "iban" + s[:2], key, back)
    check = 98 - _iban_number(s[:2] + "00" + body) % 97
    return _refill(v, f"{s[:2]}{check:02d}{body}")


def _ipv4(v, key, back):
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = 0
    for p in parts:
        n = n * 256 + int(p)
    n = _walk(n, 1 << 32, "ipv4", key, back)
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def _phone(v, key, back):
    d = re.sub(r"\D", "", v)[-10:]
    if d[0] < "2" or d[3] < "2":
        return None
    n = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10000 + int(d[6:])
    n = _walk(n, 800 * 800 * 10000, "phone", key, back)
    head, line = divmod(n, 10000)
    area, office = divmod(head, 800)
    lead = "1" if len(re.sub(r"\D", "", v)) == 11 else ""
    return _refill(v, f"{lead}{area + 200}{office + 200}{line:04d}")


def _ssn_rank(area: int) -> int:
    return area - 1 - (area > 666)


def _ssn(v, key, back):
    area, group, serial = (int(p) for p in v.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    n = (_ssn_rank(area) * 99 + group - 1) * 9999 + serial - 1
    n, serial = divmod(_walk(n, 898 * 99 * 9999, "ssn", key, back), 9999)
    area, group = divmod(n, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(v, key, back):
    form = "%Y-%m-%d" if "-" in v else "%d.%m.%Y" if "." in v else "%m/%d/%Y"
    try:
        n = datetime.datetime.strptime(v, form).date().toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= n < _DAYS:
        return None
    return datetime.date.fromordinal(_walk(n, _DAYS, "date", key, back) + _FIRST_DAY).strftime(form)


def _email(v, key, back):
    local, _, domain = v.rpartition("@")
    return _symbols(local, "email@" + domain.lower(), key, back) + "@" + domain


_RULES = {"secret": _secret, "email": _email, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "card": _card, "phone": _phone, "iban": _iban}


def pseudonymize(text: str | None, key: bytes = DEFAULT_KEY, decrypt: bool = False) -> tuple[str | None, list]:
    """The text with every validated value replaced, and ``(start, end, kind)`` of each in the new text."""
    if not text or not _HINT.search(text):
        return text, []
    found, failed = _find(text, key)
    new = _permute(text, found, failed, key, decrypt)
    out, spans, at, size = [], [], 0, 0
    for (start, end, kind), v in zip(found, new):
        out += [text[at:start], v]
        size += start - at
        spans.append((size, size + len(v), kind))
        size += len(v)
        at = end
    return "".join([*out, text[at:]]), spans


def _ends(kind: str, text: str, start: int, end: int):
    """The end of a candidate and its shorter group boundaries, longest first."""
    yield end
    if kind in ("card", "iban"):
        least = 13 if kind == "card" else 15
        size = sum(c.isalnum() for c in text[start:end])
        for i in range(end - 1, start, -1):
            if text[i].isalnum():
                size -= 1
            elif size >= least:
                yield i


def _find(text: str, key: bytes) -> tuple[list, list]:
    """Spans ``(start, end, kind)`` of the values that validate, and of the candidates that do not."""
    found, failed, at = [], [], 0
    while m := _FIND.search(text, at):
        kind = m.lastgroup
        start, end = m.span(kind)
        at = start + 1
        others = iter(list(_ONE)[list(_ONE).index(kind) + 1:] if kind in _ONE else _ONE)
        while kind:
            good = None
            for e in _ends(kind, text, start, end):
                if _RULES[kind](text[start:e], key, False) is not None:
                    good = e
                    break
                failed.append((start, e, kind))
            if good:
                found.append((start, good, kind))
                at = good
                break
            for kind in others:
                if n := _ONE[kind].match(text, start):
                    end = n.end()
                    break
            else:
                kind = None
    return found, failed


def _permute(text: str, found: list, failed: list, key: bytes, back: bool) -> list:
    """New values of the spans.  Failed candidates overlap only values of constant
    length.  They must fail in the new text too: a value is walked on until they do,
    from left to right, and decryption undoes it from right to left."""
    new, now, near = [""] * len(found), None, []
    if failed:
        failed = sorted(failed)
        starts = [f[0] for f in failed]
        longest = max(e - s for s, e, _ in failed)
        near = [[f for f in failed[bisect.bisect_left(starts, s - longest):bisect.bisect_left(starts, e)] if f[1] > s] for s, e, _ in found]
        if any(near):
            now = list(text)
    for i in range(len(found) - 1, -1, -1) if back else range(len(found)):
        start, end, kind = found[i]
        v = _RULES[kind](text[start:end], key, back)
        if now and len(v) == end - start:
            now[start:end] = v
            while near[i] and any(_RULES[k]("".join(now[s:e]), key, False) is not None for s, e, k in near[i]):
                v = _RULES[kind](v, key, back)
                now[start:end] = v
        new[i] = v
    return new


def replace(docs: DataFrame, keep: list, text: str = "text", key: bytes = DEFAULT_KEY, decrypt: bool = False) -> DataFrame:
    """``keep`` columns of every row with ``text`` replaced, plus ``n_pii`` and ``pii``
    (spans: start, end in the new text, kind)."""
    src = docs.select(*[c for c in keep if c != text], F.col(text).alias("__text"))
    span = T.StructType().add("start", "integer").add("end", "integer").add("kind", "string")
    schema = src.drop("__text").schema.add(text, "string").add("n_pii", "integer").add("pii", T.ArrayType(span))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for b in batches:
            col = b.column(b.num_columns - 1)
            hit = pc.fill_null(pc.match_substring_regex(col, "[0-9@=:]"), False).to_numpy(zero_copy_only=False)
            texts, spans = col.to_pylist(), [[]] * len(col)
            for i in hit.nonzero()[0]:
                texts[i], found = pseudonymize(texts[i], key, decrypt)
                spans[i] = [{"start": s, "end": e, "kind": k} for s, e, k in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(texts, col.type), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, kind)],
                names=[*b.schema.names[:-1], text, "n_pii", "pii"])

    return src.mapInArrow(tidy(run), schema)
