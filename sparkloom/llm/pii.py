"""Personal data by anchor expansion: an automaton finds anchors, local parsers take it from there."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]
SLICE = 512
#: Identifier cues and the kind of what follows them.
CUES = {"account": "account", "acct": "account", "iban": "account", "routing": "account", "passport": "account", "ssn": "account", "customer id": "account", "member id": "account", "token": "secret", "api key": "secret", "api_key": "secret", "apikey": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "passphrase": "secret", "access key": "secret", "access_key": "secret", "private key": "secret", "bearer": "secret"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE_RUN = re.compile(r"[\x20().0-9-]+")
_URL_REST = re.compile(r"[^\s<>\"']+")
_HEAD = r"(?:\s{0,2}(?:number|no\.?|id|key|code))?\s{0,3}[:=#]?\s{0,3}[\"']?"
#: What stands between a secret's cue and the secret: the sign that gives it, and a quote.
_BEFORE_SECRET = re.compile(r"(?:\s{0,2}(?:number|no\.?|id|key|code|value))?[\"'`]?(?:\s{0,3}(:=|=>|[:=]|\bis\b|#))?\s{0,3}([\"'`]?)(?=[A-Za-z0-9][A-Za-z0-9_-]{5})")
#: How keys of well-known services begin.
_KEY_PREFIX = re.compile(r"(?:sk|pk|rk)[-_][A-Za-z0-9]|gh[opsu]_|github_pat_|glpat-|xox[abeprs]-|AKIA|ASIA|AIza|eyJ")
_BEFORE_GROUP = re.compile(_HEAD + r"(?=[A-Za-z0-9])")
_RUN = re.compile(r"[A-Za-z0-9_-]+")
#: Tokens go on over the marks of base64, of three-part tokens and of paths, but don't end on a stop.
_TOKEN = re.compile(r"[A-Za-z0-9_-]+(?:[./+=]+[A-Za-z0-9_-]+)*=*")
_SSN = re.compile(r"([0-9]{3})[- ]?([0-9]{2})[- ]?([0-9]{4})(?![A-Za-z0-9_-])")
_ROUTING = re.compile(r"[0-9]{9}(?![A-Za-z0-9_-])")
_PASSPORT = re.compile(r"[A-Za-z]{0,2}[0-9]{5,9}[A-Za-z]?(?![A-Za-z0-9_-])")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
_GROUPS = re.compile(r"[0-9]{2,5}(?:\x20[0-9]{2,}(?![A-Za-z0-9_-]))+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(text: str, at: int) -> int:
    """End of an IBAN at `at`, plain or in printed groups, whose checksum holds; else 0."""
    if m := _IBAN.match(text, at):
        for stop in range(m.end(), at + 14, -1):
            if text[stop : stop + 1].isalnum() or text[stop - 1] == " ":
                continue
            code = text[at:stop].replace(" ", "").upper()
            if len(code) >= 15 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return stop
    return 0


def ssn(text: str, at: int) -> int:
    """End of a social security number: 3, 2 and 4 digits, of an area, group and serial in use."""
    m = _SSN.match(text, at)
    return m.end() if m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000" else 0


def routing(text: str, at: int) -> int:
    """End of a bank's routing number: nine digits whose sum by weights 3, 7, 1 is divisible by 10."""
    m = _ROUTING.match(text, at)
    return m.end() if m and sum(int(d) * w for d, w in zip(m[0], (3, 7, 1) * 3)) % 10 == 0 else 0


def passport(text: str, at: int) -> int:
    """End of a passport number: five to nine digits, at most two letters before and one behind."""
    m = _PASSPORT.match(text, at)
    return m.end() if m and 6 <= len(m[0]) <= 11 else 0


def account(text: str, at: int) -> int:
    """End of an account number: an IBAN, groups of two digits or more, six at least together, the
    first of at most five, or a run of six letters and digits or more with four digits."""
    if stop := iban(text, at):
        return stop
    if (m := _GROUPS.match(text, at)) and sum(c != " " for c in m[0]) >= 6:
        return m.end()
    m = _RUN.match(text, at)
    return m.end() if m and len(m[0]) >= 6 and sum(c in "0123456789" for c in m[0]) >= 4 else 0


def secret(run: str, sign: str | None, quoted: bool) -> bool:
    """Whether what follows a secret's cue looks like one, by the sign between and its shape: a key
    prefix, four digits or more, or, behind a sign, what is quoted, mixes letters with digits or
    cases from eight characters on, or is longer than words are. A word alone is none."""
    digits = sum(c in "0123456789" for c in run)
    if digits >= 4 or len(run) >= 16 and _KEY_PREFIX.match(run):
        return True
    if not sign:
        return False
    letters = [c for c in run if c.isalpha()]
    mixed = any(c.isupper() for c in letters[1:]) and any(c.islower() for c in letters)
    return quoted and sign != "is" or len(run) >= 8 and bool(digits or mixed) or len(run) >= 16 and sign != "is"


#: What reads the identifier behind a cue; `account` behind all others of its kind.
PARSERS = {"iban": iban, "ssn": ssn, "routing": routing, "passport": passport}


def automaton():
    """Aho-Corasick over at-sign, plus, scheme mark, digits and identifier cues."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    auto.add_word("@", ("@", 1))
    auto.add_word("+", ("+", 1))
    auto.add_word("://", ("s", 3))
    for d in "0123456789":
        auto.add_word(d, ("d", 1))
    for cue in CUES:
        for form in {cue, cue.title(), cue.upper(), cue.capitalize()}:
            auto.add_word(form, (cue, len(form)))
    auto.make_automaton()
    return auto


def find(text: str, auto) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in code points, end exclusive. Each parser keeps where its last match
    ended, valid or not, so matches are the leftmost ones that don't overlap. Every parser is
    linear in the text: runs that failed are not tried again."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end, failed = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for last, (what, size) in auto.iter(text):
        at = last - size + 1
        if what == "d":
            if at >= end["ip"]:
                if m := _IP.match(text, at):
                    end["ip"] = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                        out["ip"].append(m.span())
                else:
                    end["ip"] = _DIGITS.match(text, at).end()
            if at >= end["card"] and (m := _CARD.match(text, at)):
                end["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif what == "@":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end["email"] = m.end()
                out["email"].append((start, m.end()))
        elif what == "+":
            if at >= end["phone"] and text[at + 1 : at + 2] in tuple("0123456789"):
                run = _PHONE_RUN.match(text, at + 1)[0].rstrip(" ().-")
                if len(run) >= 3:
                    end["phone"] = at + 1 + len(run)
                    if 8 <= sum(c.isdecimal() for c in run) <= 15:
                        out["phone"].append((at, end["phone"]))
        elif what == "s":
            start = at
            while start > end["url"] and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := _URL_REST.match(text, last + 1)):
                stop = m.end() - (len(m[0]) - len(m[0].rstrip(".,;:!?)]}")))
                if stop > last + 1:
                    end["url"] = stop
                    out["url"].append((start, stop))
        elif at >= end[kind := CUES[what]] and not (at and text[at - 1].isalnum()):
            if kind == "account":
                m = _BEFORE_GROUP.match(text, last + 1)
                if m and m.end() >= failed[kind]:
                    if stop := PARSERS.get(what, account)(text, m.end()):
                        end[kind] = stop
                        out[kind].append((m.end(), stop))
                    elif what not in PARSERS:  # nor has any end of this run four digits
                        failed[kind] = _RUN.match(text, m.end()).end()
            elif (m := _BEFORE_SECRET.match(text, last + 1)) and m.end() >= failed[kind]:
                run = _TOKEN.match(text, m.end())
                if secret(run[0], m[1], bool(m[2]) and text[run.end() : run.end() + 1] == m[2]):
                    end[kind] = run.end()
                    out[kind].append(run.span())
                else:
                    failed[kind] = run.end()
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = automaton()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            counts: list[list[int]] = [[] for _ in KINDS]
            base, spans = [], []
            for text in part.column(1).to_pylist():
                found = find(text or "", auto)
                said = [[f"{k}:{s}:{e}" for s, e in found[k]] for k in KINDS]
                for c, k in zip(counts, KINDS):
                    c.append(len(found[k]))
                base.append(",".join(x for xs in said[: len(BASE)] for x in xs))
                spans.append(",".join(x for xs in said for x in xs))
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Find personal data in whole texts: doc_id, n_<kind> for each of KINDS, base_sha256 (of the
    spans of BASE kinds), spans (kind:start:end, by kind as listed, then start) and n_private (spans
    of all kinds but url), a row per document; one scan without a shuffle.

    Null text counts as empty and has no spans; repeated rows are scanned like others; other
    columns are ignored, whatever their names; an empty table gives an empty one."""
    lean_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    found = docs.select("doc_id", "text").mapInArrow(_scan, schema)
    return found.withColumn("n_private", sum((F.col(f"n_{k}") for k in KINDS if k != "url"), F.lit(0).cast("long")))


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with spans replaced by their kind in brackets. Spans that overlap are replaced as one,
    by all their kinds, so that nothing of any span stays; an empty text stays empty."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, xs in found.items() for s, e in xs):
        if out and s < at:
            at, kinds = max(at, e), out[-1][1:-1].split("+")
            out[-1] = f"[{'+'.join([*kinds, *([k] if k not in kinds else [])])}]"
        else:
            out += [text[at:s], f"[{k}]"]
            at = e
    return "".join(out) + text[at:]
