"""Personal data: Aho-Corasick anchors, from which local parsers expand and validate.

One pass of the automaton over a text gives the places of at-signs, plus signs, digits,
scheme separators and identifier cues. Each anchor has a parser that reads only around
it: it expands to the boundary of an address, number or account and checks it. No
shuffle; memory follows one Arrow batch.

Edge cases: a null text is an empty one and has no spans; empty tables give no rows;
repeated rows, ties and null ids give one row each; texts of any length are parsed whole,
as are schemes and names of any length; only doc_id and text are read, so extra columns
can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tagmill.llm.common import narrow

#: In the order that ties of start are listed.
KINDS = ("email", "ip", "card", "phone", "url", "secret", "account")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"://(?:[^\s/@<>\"']++@)?[A-Za-z0-9.-]++(?::[0-9]++)?(?:[/?#][^\s<>\"')\]]*+)?")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_NAME = re.compile(r"[A-Za-z0-9_-]*+")
_VALUE = re.compile(r"[\"']?[\x20\t]*+[=:][\x20\t]*+([\"']?)([A-Za-z0-9+/_.~-]{6,}+)(\1)")
_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id))?[\x20\t]?[:#=]?[\x20\t]?([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,17}+)(?![A-Za-z0-9])", re.I)
#: Cues of identifiers and what parses what follows them; matched without regard to case in ASCII.
CUES = {"password": "secret", "passwd": "secret", "token": "secret", "secret": "secret", "api_key": "secret", "apikey": "secret", "akia": "key", "iban": "iban", "account": "account", "acct": "account", "passport": "account", "ssn": "account", "konto": "account", "compte": "account", "cuenta": "account"}
#: Letters alone are a secret in quotes from the first length on, and bare from the second on if in both cases.
QUOTED, BARE = 8, 16
_FOLD = {k: k + 32 for k in range(65, 91)}


def folded(text: str) -> str:
    """text with A-Z in lower case, every character in its place."""
    if text.isascii():
        return text.lower()
    return text.translate(_FOLD)


def is_secret(value: str, quoted: bool) -> bool:
    """Whether what a cue names can be a secret rather than a word of prose."""
    if any(c.isdigit() for c in value):
        return True
    return quoted and len(value) >= QUOTED or len(value) >= BARE and not value.islower() and not value.isupper()


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for c in "0123456789":
        out.add_word(c, ("digit", 1))
    out.add_word("@", ("email", 1))
    out.add_word("+", ("phone", 1))
    out.add_word("://", ("url", 3))
    for cue, kind in CUES.items():
        out.add_word(cue, (kind, len(cue)))
    out.make_automaton()
    return out


_built = None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as in KINDS; of each kind leftmost, not overlapping."""
    global _built
    if _built is None:
        _built = _automaton()
    found: list[tuple[int, int, str]] = []
    free = dict.fromkeys((*KINDS, "digit_ip", "name"), 0)  # from where each kind may begin

    def keep(kind: str, start: int, end: int, valid: bool = True) -> None:
        free[kind] = end
        if valid:
            found.append((start, end, kind))

    for last, (anchor, width) in _built.iter(folded(text)):
        at = last - width + 1
        if anchor == "digit":
            if at >= free["card"]:
                m = _CARD.match(text, at)
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    keep("card", at, m.end(), 12 <= len(digits) <= 19 and luhn(digits))
                else:
                    free["card"] = at + 1
            if at >= free["digit_ip"]:
                m = _IP.match(text, at)
                if m:
                    keep("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")))
                    free["digit_ip"] = m.end()
                else:
                    free["digit_ip"] = _DIGITS.match(text, at).end()
        elif anchor == "email":
            start, least = at, free["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and at >= least and (m := _DOMAIN.match(text, at + 1)):
                keep("email", start, m.end())
        elif anchor == "phone":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                keep("phone", at, m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif anchor == "url":
            start, least = at, free["url"]
            while start > least and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if start < at and (m := _URL.match(text, at)):
                keep("url", start, m.end())
        elif anchor == "secret":
            if last + 1 < free["name"]:  # another cue within the same name
                continue
            free["name"] = _NAME.match(text, last + 1).end() + 1
            m = _VALUE.match(text, free["name"] - 1)
            if m and m.start(2) >= free["secret"] and is_secret(m[2], bool(m[1])):
                keep("secret", m.start(2), m.end(2))
        elif anchor == "key":
            if at >= free["secret"] and text[at : last + 1] == "AKIA" and (at == 0 or not text[at - 1].isalnum()) and (m := _KEY.match(text, last + 1)):
                keep("secret", at, m.end())
        elif anchor == "iban":
            m = _IBAN.search(text, last + 1, last + 48)
            if m and m.start() <= last + 6 and m.start() >= free["account"] and _iban_valid(m[0]):
                keep("account", m.start(), m.end())
        else:
            m = _ACCOUNT.match(text, last + 1)
            if m and m.start(1) >= free["account"]:
                keep("account", m.start(1), m.end(1))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[0], order[x[2]]))


def _iban_valid(text: str) -> bool:
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each union of overlapping spans replaced by the name of the kind of its longest one."""
    out, at, k = [], 0, 0
    spans = sorted(spans, key=lambda x: x[0])
    while k < len(spans):
        start, end, kind = spans[k]
        width, k = end - start, k + 1
        while k < len(spans) and spans[k][0] < end:
            a, b, other = spans[k]
            if b - a > width:
                width, kind = b - a, other
            end, k = max(end, b), k + 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = b.column("doc_id"), []
        for text in b.column("text"):
            spans = find_spans(text.as_py() or "")
            count = {k: sum(s[2] == k for s in spans) for k in BASE}
            base = listed([s for s in spans if s[2] in BASE])
            rows.append((*count.values(), hashlib.sha256(base.encode()).hexdigest(), listed(spans)))
        counts = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in counts[:4]], *[pa.array(x, pa.string()) for x in counts[4:]]], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])


def op3_pii(docs: DataFrame) -> DataFrame:
    source = narrow(docs, "doc_id", "text")
    return source.mapInArrow(_scan, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text; a column n_chars follows the new text. All other columns pass through."""
    text_at, size_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redact(t, find_spans(t)) for t in (x.as_py() for x in b.column(text_at))]
            columns = list(b.columns)
            columns[text_at] = pa.array(texts, pa.string())
            if size_at is not None:
                columns[size_at] = pa.array([None if t is None else len(t) for t in texts], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema.set(text_at, pa.field(b.schema.field(text_at).name, pa.string())))

    return docs.mapInArrow(run, docs.schema)


