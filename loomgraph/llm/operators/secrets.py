"""Credentials embedded in source code, found by characters per subword and context, blanked out in place.

First every literal and every long run of characters behind a name is scored: a
string is *unnatural* if a public tokenizer's vocabulary cuts it into subwords of
few characters each; words and identifiers get long ones. What is unnatural is a
credential unless its context says that it is something else (a hash, an id, a
public key, encoded data, a row of a list). Then context rules find the
credentials that look like words: passwords under a credential's name or in an
authorisation header, of a URL, connection string or login, and key blocks.
Placeholders and lookups without default are none. Redaction puts as many ``x``
in the place of the value, so that quotes, offsets and line numbers stay.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.operators.tokens import VOCABULARY, encoder, vocabulary_file

#: Characters per subword below which a string is unnatural.
UNNATURAL = 2.7
#: The same for a string whose name says nothing about it, and its least length.
STRANGE, STRANGE_CHARS = 2.0, 20
#: Least length of a token and of a password.
TOKEN_CHARS, PASSWORD_CHARS = 12, 6

#: Words of names that hold a credential, and last words that say the name holds something about one.
PASSWORD_NAMES = {"password", "passwd", "pwd", "passphrase", "passcode", "pass", "passw", "passwort", "kennwort", "passe", "contrasena", "contrasenia", "senha"}
TOKEN_NAMES = {"token", "secret", "apikey", "authkey", "accesskey", "secretkey", "privatekey", "signingkey", "authtoken", "accesstoken", "apitoken", "clientsecret", "webhooksecret", "credential", "credentials", "bearer", "authorization"}
KEY_KINDS = {"api", "access", "secret", "private", "signing", "encryption", "auth", "service", "master", "account", "client", "storage", "license", "subscription", "app", "session", "deploy", "webhook"}
ABOUT = {"count", "counts", "url", "uri", "name", "names", "type", "length", "size", "path", "file", "id", "ids", "hash", "sha", "digest", "checksum", "fingerprint", "expiry", "expires", "ttl", "pattern", "regex", "prefix", "header", "field", "label", "policy", "hint", "public", "index", "limit", "list", "map", "class", "error", "message"}
#: Last words of names that hold something long and unnatural that is no credential, and words that say so anywhere.
DATA = {"uuid", "guid", "sha1", "sha256", "sha512", "md5", "crc", "etag", "revision", "commit", "integrity", "version", "build", "trace", "span", "request", "correlation", "icon", "pixel", "image", "img", "logo", "font", "favicon", "svg", "png", "data", "blob", "bytes", "base64", "encoded", "payload", "body", "content", "text", "alphabet", "charset", "chars", "table", "fixture", "snapshot", "sample", "expected", "actual", "cursor", "nonce", "cert", "certificate", "signature", "key"}
DENYING = {"public", "hash", "sha", "digest", "checksum", "integrity", "uuid", "base64", "encoded", "data"}
PLACEHOLDERS = {"changeme", "change-me", "change_me", "example", "password", "passwd", "secret", "token", "todo", "tbd", "none", "null", "nil", "undefined", "redacted", "placeholder", "dummy", "sample", "test", "testing", "default", "empty", "unset", "hidden", "masked", "removed", "insert-here", "fixme", "foobar", "apikey", "api-key", "api_key"}

_LITERAL = r"""(?:[rbuf]{0,2})(?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\\n])*`)"""
_STRING = re.compile(_LITERAL)
_JOINED = re.compile(rf"(?:{_LITERAL})(?:\s*(?:\+|\.(?!\w)|\\)?\s*(?:\n\s*(?:\+|\.)?\s*)?(?:{_LITERAL}))*")
#: name, then = : => or a comma or an opening bracket of a lookup, up to the literal
_NAME = re.compile(r"[\"'`]?\$?(?:[A-Za-z_][\w]*(?:->|\.|::))*([A-Za-z_][\w-]*)[\"'`]?\]?\s*(?::\s*[\w<>?\[\], |.]+?)?\s*(?:=>|:=|=(?!=)|:|,|\?\?=|\|\|=)\s*$")
_LOOKUP = re.compile(r"(?:\b(?:os\.)?(?:getenv|env|environ\.get|getProperty|getOrDefault|get|config|process\.env|System\.getenv)\s*\(\s*$)|(?:\b(?:os\.)?(?:getenv|env|environ\.get|getProperty|getOrDefault|config|System\.getenv)\s*\([^()]*$)")
_DEFAULT = re.compile(r"(?:\?\?|\|\||\?:|\bor\b)\s*$")
_LOGIN = re.compile(r"(?:->|\.|\b)(?:login|log_in|signIn|sign_in|authenticate|auth|connect|basicAuth|basic_auth|setCredentials|credentials)\s*\(\s*(?:[^()\"'`]*,\s*)?" + _LITERAL + r"\s*,\s*$", re.I)
_SCHEME = re.compile(r"(?:Bearer|Basic|Token|ApiKey|Digest)\s+", re.I)
_URL = re.compile(r"\b[a-zA-Z][\w+.-]*://([^\s/:@\"'`]*):([^\s\"'`/]+)@(?=[\w\[])")
_PAIR = re.compile(r"(?<![\w-])(password|passwd|pwd)\s*=\s*([^;\"'`\s&]+)", re.I)
_QUERY = re.compile(r"[?&]([\w-]+)=([^&\s\"'`]+)")
_LOOSE = re.compile(r"(?<![\w$-])((?:X-)?[A-Za-z_][\w-]*)\s*[:=]\s*(?:(?:Bearer|Basic|Token)\s+)?[\"'`]?([^\s\"'`,;()\[\]{}<>]{6,})", re.I)
_SPACED = re.compile(r"(?<![\w$-])([A-Za-z_][\w-]*)\s+(?:is\s+|was\s+)?(?=([^\s\"'`,;()\[\]{}<>]{8,}))")
_COMMENT = re.compile(r"\s*(?://|#|\*|/\*|--|<!--|;)|.*?\s(?://|#)\s")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/=_-]{8,}")
_KNOWN = re.compile(r"(?<![\w-])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}|AKIA[A-Z0-9]{16}|xox[abprs]-[\w-]{10,}|sk_(?:live|test)_\w{16,}|AIza[\w-]{30,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})")
#: what any name, call or header of the context rules has in it
_HOT = re.compile(r"pass|pwd|kennwort|contrase|senha|secret|token|key|auth|cred|login|bearer|connect|sign_?in", re.I)
#: a long run without quotes behind a name
_RUN = re.compile(r"(?<![\w$.-])\$?([A-Za-z_][\w-]*)[ \t]*[:=][ \t]*([A-Za-z0-9+/_~-]{20,}={0,2})(?![\w.(\[\"'`-])")
_DIGEST = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_SIGNS = re.compile(r"[!@#%&^*~?]")
#: a lookup with its name, before an operator that gives a default
_LOOKED_UP = re.compile(r"(?:\b(?:getenv|env|get|config|getProperty)\s*\(\s*[\"'](\w+)[\"'][^()]*\)|\b(?:environ|ENV|_ENV|_SERVER|env)\s*\[\s*[\"'](\w+)[\"']\s*\]|\bprocess\.env\.(\w+))\s*(?:\?\?|\|\||\?:|\bor\b)\s*$")
#: the end of a line that goes on with its value: an assignment, a bracket behind one, a default, an argument after a literal
_GOES_ON = re.compile(r"(?:(?<![=!<>])=|=>|:|[=:]\s*\(|\?\?|\|\||\?:|\bor|\(\s*(?:[^()\"'`]*,\s*)?" + _LITERAL + r"\s*,)\s*$")
_BLOCK_HEAD = re.compile(r"\s*(?:async\s+)?(?:class|def|if|else|elif|for|while|try|with|switch|case|default|except|finally|match)\b")
_BRACKET = re.compile(r"(?<=[=:])\s*\(\s*$")
#: comments and literals over lines; the other alternatives are passed over
_REGIONS = re.compile(r"(\"\"\".*?\"\"\"|'''.*?'''|/\*.*?\*/|<!--.*?-->|<<<[ \t]*[\"']?(?P<doc>[A-Za-z_]\w*)[\"']?\n.*?\n[ \t]*(?P=doc)\b|`(?:\\.|[^`\\])*`)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*", re.S)
_KEY_LINE = re.compile(r"[\s/#*\"'`+.;,>\\-]*(?:[A-Za-z0-9+/=_-]|\\[nr])*[\s\"'`+.;,\\]*")
_PLAIN = re.compile(r"[a-z]+(?:[-/._ ][a-z]+)*")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str
    #: characters per subword of the value
    score: float = 0.0


def name_kind(name: str) -> str | None:
    """``password``, ``token`` or None: what a variable, key or header of this name holds."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if words and words[0] == "x" and len(words) > 1:
        words = words[1:]
    if not words or words[-1] in ABOUT or "public" in words:
        return None
    whole = "".join(words)
    if set(words) & PASSWORD_NAMES or whole.endswith(("password", "passwd", "passphrase")):
        return "password"
    if words[-1] in TOKEN_NAMES or whole in TOKEN_NAMES or any(whole.endswith(t) for t in ("apikey", "secret", "authtoken", "accesskey", "credential", "signingkey")):
        return "token"
    return "token" if words[-1] == "key" and len(words) > 1 and words[-2] in KEY_KINDS or "secret" in words else None


def placeholder(v: str) -> bool:
    low = v.lower().strip()
    bare = re.sub(r"[^a-z0-9]+", "", low)
    if low in PLACEHOLDERS or bare in PLACEHOLDERS or len(set(bare)) <= 2:
        return True
    if re.search(r"^<.*>$|\{\{|\$\{|\{[\w.]*\}|^%\w?$|%\(\w+\)[sd]|^\$[A-Z_a-z]|^\[.*\]$|#\{", v):
        return True
    return bool(re.match(r"(?:your|my|the|insert|enter|replace|put|use|change|some|xxx|example|dummy|fake|test)[-_ ]", low) or re.search(r"(?:goes|your)[-_]?here|changeme|placeholder|redacted|\*\*\*|\.\.\.", low))


class Finder:
    """Finds the credentials of a text; ``encode`` gives subwords."""

    def __init__(self, encode):
        self.encode = encode

    def score(self, v: str) -> float:
        """Characters per subword."""
        return len(v) / max(1, len(self.encode(v)))

    def unnatural(self, v: str) -> bool:
        return self.score(v) < UNNATURAL

    def strange(self, name: str | None, v: str) -> bool:
        """Whether an unnatural string under a name that says nothing of credentials is one: long, mixed, no digest, no data."""
        if len(v) < STRANGE_CHARS or sum(map(str.isdigit, v)) < 2 or v.islower() and v.isalpha() or any(c.isspace() for c in v) or not name:
            return False
        words = [w.lower() for w in _WORDS.findall(name)] or [name]
        if words[-1] in DATA or words[-1] in ABOUT or name.lower() in DATA or words[-1].isdigit() or not DENYING.isdisjoint(words) or _DIGEST.fullmatch(v) or placeholder(v) or "://" in v or ":" in v[:12] or v.startswith(("sha256-", "sha384-", "sha512-")):
            return False
        return any(c.isupper() for c in v) and any(c.islower() for c in v) and self.score(v) < STRANGE

    def _unnatural(self, code: str) -> Iterator[Found]:
        """Every literal and every long run behind a name, by its subwords first and then by what its name denies."""
        for m in _STRING.finditer(code):
            v = m.group().lstrip("rbuf")[1:-1]
            if len(v) >= STRANGE_CHARS and " " not in v:
                name = _NAME.search(code, max(code.rfind("\n", 0, m.start()) + 1, m.start() - 200), m.start())
                if name and self.strange(name.group(1), v):
                    yield Found(m.end() - 1 - len(v), m.end() - 1, "unnatural")
        for m in _RUN.finditer(code):
            if self.strange(m.group(1), m.group(2)):
                yield Found(m.start(2), m.end(2), "unnatural")

    def password(self, v: str) -> bool:
        if len(v) < PASSWORD_CHARS or any(c.isspace() for c in v) or placeholder(v) or _PLAIN.fullmatch(v):
            return False
        if re.fullmatch(r"[A-Z][A-Z0-9_]*", v) and not any(c.isdigit() for c in v):
            return False
        return any(c.isdigit() or not c.isalnum() for c in v) or self.unnatural(v)

    def token(self, v: str) -> bool:
        return len(v) >= TOKEN_CHARS and not any(c.isspace() for c in v) and not placeholder(v) and not _PLAIN.fullmatch(v) and not v.startswith(("data:", "http://", "https://", "sha256-", "sha384-", "sha512-")) and any(c.isdigit() for c in v) and self.unnatural(v)

    def holds(self, kind: str, v: str) -> bool:
        return self.password(v) if kind == "password" else self.token(v) or len(v) >= 8 and bool(_SIGNS.search(v)) and self.password(v)

    def find(self, code: str | None) -> list[Found]:
        """Non-overlapping credentials in order; of overlapping ones the first found by start, then the longest."""
        if not code:
            return []
        out = list(self._unnatural(code))
        if "PRIVATE KEY" in code:
            out.extend(self._blocks(code))
        if "://" in code:
            for m in _URL.finditer(code):
                v = m.group(2)
                if len(v) >= 4 and not placeholder(v) and not re.fullmatch(r"[A-Z_]+|[a-z]+", v):
                    out.append(Found(m.start(2), m.end(2), "url"))
        for m in _KNOWN.finditer(code) if ("eyJ" in code or "_" in code or "AKIA" in code or "AIza" in code or "xox" in code or "glpat" in code) else ():
            if not placeholder(m.group()):
                out.append(Found(m.start(), m.end(), "known"))
        done, within = -1, None
        for m in _HOT.finditer(code):
            if m.start() < done:
                continue
            lo = code.rfind("\n", 0, m.start()) + 1
            hi = code.find("\n", m.start())
            hi = done = len(code) if hi < 0 else hi
            if not _COMMENT.match(code, lo, hi):
                if within is None:
                    within = [(r.start(1), r.end(1)) for r in _REGIONS.finditer(code) if r.group(1) and "\n" in r.group(1)]
                k = bisect.bisect_right(within, (m.start(), len(code))) - 1
                if k >= 0 and m.start() < within[k][1]:
                    a, b = max(lo, within[k][0]), min(hi, within[k][1])
                    out.extend(self._loose(code[a:b], a))
                # a value on the next lines belongs to this one
                while hi < len(code) and _GOES_ON.search(code, max(lo, hi - 400), hi) and not _BLOCK_HEAD.match(code, lo, hi):
                    hi = code.find("\n", hi + 1)
                    hi = len(code) if hi < 0 else hi
                    lines = code[lo:hi]
                    if lines.rsplit("\n", 1)[-1].strip() and not _GOES_ON.search(lines, max(0, len(lines) - 400)):
                        break
                done = max(done, code.rfind("\n", 0, hi)) if hi > done else done
            out.extend(self._line(code, lo, hi))
        out.sort(key=lambda f: (f.start, -f.end))
        kept: list[Found] = []
        for f in out:
            if not kept or f.start >= kept[-1].end:
                kept.append(replace(f, score=self.score(code[f.start : f.end])))
        return kept

    def _blocks(self, code: str) -> Iterator[Found]:
        for m in _BEGIN.finditer(code):
            end = _END.search(code, m.end())
            stop = end.start() if end else self._key_end(code, m.end())
            body = code[m.end() : stop]
            cut = re.search(r"\n\s*\n|-----BEGIN", body)
            if cut and not end:
                body = body[: cut.start()]
            if sum(len(b) for b in _BODY.findall(body) if len(set(b)) > 2) >= 16:
                yield Found(m.start(), end.end() if end else m.end() + len(body), "block")

    def _key_end(self, code: str, at: int) -> int:
        """The end of a key block without its last line: as far as lines are key text."""
        stop = at
        while stop < len(code):
            hi = code.find("\n", stop)
            hi = len(code) if hi < 0 else hi
            if not _KEY_LINE.fullmatch(code, stop, hi) or stop > at and not code[stop:hi].strip():
                break
            stop = min(len(code), hi + 1)
        return stop

    def _line(self, code: str, lo: int, hi: int) -> Iterator[Found]:
        line = code[lo:hi]
        at = 0
        while s := _STRING.search(line, at):
            at = s.end()
            before = _BRACKET.sub(" ", line[: s.start()])
            kind, scheme = self._context(before, line, s)
            # a literal with more to it behind + or . goes on, also over lines
            whole = _JOINED.match(code, lo + s.start())
            parts = [(whole.start() + p.start(), p.group()) for p in _STRING.finditer(whole.group())] if whole else [(lo + s.start(), s.group())]
            value = "".join(p[1].lstrip("rbuf")[1:-1] for p in parts)
            first = parts[0][0] + len(s.group()) - len(s.group().lstrip("rbuf")) + 1
            if kind:
                skip = _SCHEME.match(value)
                bare = value[skip.end() :] if skip else value
                if self.holds(kind, bare) or scheme and skip and len(bare) >= TOKEN_CHARS and not placeholder(bare) and self.unnatural(bare):
                    yield Found(first + (skip.end() if skip else 0), parts[-1][0] + len(parts[-1][1]) - 1, kind)
                    at = max(at, min(parts[-1][0] + len(parts[-1][1]) - lo, len(line)))
                    continue
            yield from self._inside(value if len(parts) == 1 else s.group().lstrip("rbuf")[1:-1], first)
        mark = _COMMENT.match(line)
        if mark:
            line = line.split("\n", 1)[0]
            yield from self._loose(line[mark.end() :], lo + mark.end())
            for m in _SPACED.finditer(line, mark.end()):
                if name_kind(m.group(1)) and self.token(m.group(2)):
                    yield Found(lo + m.start(2), lo + m.end(2), "comment")

    def _context(self, before: str, line: str, s: re.Match) -> tuple[str | None, bool]:
        if _LOGIN.search(before):
            return "password", False
        head = _LOOKUP.search(before)
        default = _DEFAULT.search(before)
        if head:
            args = before[head.start() :]
            if "," not in args:  # the name that is looked up
                return None, False
            before = before[: head.start()]
            key = _STRING.search(args)
            own = name_kind(key.group()[1:-1]) if key else None
            name = _NAME.search(before)
            # what stands in for a credential in its lookup is one, however weak
            return "password" if own or name and name_kind(name.group(1)) else None, False
        if default:
            key = _LOOKED_UP.search(before)
            if key and name_kind(next(filter(None, key.groups()))):
                return "password", False
            name = re.match(r"\s*(?:(?:export|public|private|protected|static|final|const|let|var|val)\s+)*\$?(?:\w+(?:->|\.))*(\w+)", before)
            return name_kind(name.group(1)) if name else None, False
        name = _NAME.search(before)
        if not name:
            return None, False
        n = name.group(1)
        # a comma names a value only where the name is itself a literal: put("name", "value")
        if re.search(r",\s*$", before) and not re.search(r"[\"'`]\s*,\s*$", before):
            return None, False
        return name_kind(n), n.lower().replace("-", "") in ("authorization", "xauthorization", "proxyauthorization")

    def _inside(self, value: str, at: int) -> Iterator[Found]:
        if "=" in value:
            for m in _PAIR.finditer(value):
                if (";" in value or "://" in value or " " in value) and self.password(m.group(2)):
                    yield Found(at + m.start(2), at + m.end(2), "pair")
            if "?" in value:
                for m in _QUERY.finditer(value):
                    k = name_kind(m.group(1))
                    if k and self.holds(k, m.group(2)):
                        yield Found(at + m.start(2), at + m.end(2), "query")
        if ":" in value or "=" in value:
            yield from self._loose(value, at)

    def _loose(self, text: str, at: int) -> Iterator[Found]:
        for m in _LOOSE.finditer(text):
            k = name_kind(m.group(1))
            if k and self.holds(k, m.group(2)) and not m.group(2).startswith(("$", "//")) and not re.search(r"\w\.\w+$|->", m.group(2) if k == "password" and not any(c.isdigit() for c in m.group(2)) else ""):
                yield Found(at + m.start(2), at + m.end(2), k)


def redact(code: str, found: list[Found]) -> str:
    """The text with as many ``x`` as a value has characters; of pieces and blocks only letters, digits and their signs, not quotes, line ends or comment marks."""
    out, at = [], 0
    for f in found:
        out.append(code[at : f.start])
        v = code[f.start : f.end]
        if f.kind == "block":
            head, tail = _BEGIN.match(v), _END.search(v)
            lo, hi = head.end(), tail.start() if tail else len(v)
            v = v[:lo] + re.sub(r"[A-Za-z0-9+/=_-]{4,}", lambda m: "x" * len(m.group()), v[lo:hi]) + v[hi:]
        elif re.search(r"[\"'`]", v):
            pieces = re.split(r"([\"'`]\s*(?:[+.\\]\s*)?(?:\n\s*(?:[+.]\s*)?)?[rbuf]{0,2}[\"'`])", v)
            v = "".join(p if i % 2 else "x" * len(p) for i, p in enumerate(pieces))
        else:
            v = "x" * len(v)
        out.append(v)
        at = f.end
    return "".join([*out, code[at:]])


def credentials(rows: DataFrame, vocabulary: str = VOCABULARY, text: bool = False) -> DataFrame:
    """``(id, line_no, start, length, kind, score)`` of each credential in ``code``, or with ``text`` ``(id, found, code)`` of the redacted texts that had one.

    ``score`` is the value's characters per subword; below ``UNNATURAL`` it is unnatural.

    Lines are counted from 1 and end at LF. Rows with a null id, null or empty
    code give nothing; repeated rows repeat their results.
    """
    ddl = "id string, found int, code string" if text else "id string, line_no long, start long, length long, kind string, score double"

    content = vocabulary_file(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(encoder(vocabulary, content))
        names = ["id", "found", "code"] if text else ["id", "line_no", "start", "length", "kind", "score"]
        types = [pa.string(), pa.int32(), pa.string()] if text else [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
        for b in batches:
            out = []
            for key, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = finder.find(code)
                if text and found:
                    out.append((key, len(found), redact(code, found)))
                elif not text:
                    out.extend((key, code.count("\n", 0, f.start) + 1, f.start, f.end - f.start, f.kind, f.score) for f in found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names=names)

    return rows.select("id", "code").where(F.col("id").isNotNull() & F.col("code").isNotNull()).mapInArrow(run, ddl)
