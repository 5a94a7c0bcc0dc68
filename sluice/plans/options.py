"""Load options: keywords and aliases, value parsers, control files, and what is checked before a job starts."""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass, field, fields, replace

INFINITE = 2**63 - 1
#: Other names of keywords (fixed values).
ALIASES = {
    "LOADER": "WRITER", "INFILE": "INPUT", "TABLE": "OUTPUT", "MAX_ERR_CNT": "PARSE_ERRORS", "LOAD": "LIMIT", "OFFSET": "SKIP",
}
#: Keywords that may be given again: the last one counts.
AGAIN = {"TRUNCATE", "VERBOSE", "CHECK_CONSTRAINTS", "PRESERVE_BLANKS", "ON_DUPLICATE_KEEP", "MULTI_PROCESS", "FAST_TIMESTAMP"}
#: Keywords whose values are file names.
PATHS = {"INPUT", "OUTPUT", "LOGFILE", "PARSE_BADFILE", "DUPLICATE_BADFILE"}
LIST = {"FORCE_NOT_NULL", "COL", "OUT_COL"}
COMMON = {"TYPE", "WRITER", "MULTI_PROCESS", "INPUT", "OUTPUT", "LOGFILE", "PARSE_BADFILE", "PARSE_ERRORS", "LIMIT", "VERBOSE", "FAST_TIMESTAMP"}
BY_TYPE = {
    "CSV": {"DELIMITER", "QUOTE", "ESCAPE", "NULL", "FORCE_NOT_NULL", "SKIP", "FILTER", "ENCODING"},
    "BINARY": {"COL", "PRESERVE_BLANKS", "STRIDE", "SKIP", "FILTER", "ENCODING"},
    "FUNCTION": set(),
    "TUPLE": set(),
}
BY_WRITER = {
    "DIRECT": {"CHECK_CONSTRAINTS", "DUPLICATE_BADFILE", "DUPLICATE_ERRORS", "ON_DUPLICATE_KEEP", "TRUNCATE"},
    "BINARY": {"OUT_COL"},
}
BY_WRITER["BUFFERED"] = BY_WRITER["DIRECT"]


class OptionError(ValueError):
    """An option that can't be used."""


def keyword(text: str) -> str:
    """Case doesn't matter; ``-``, ``_`` and space are the same."""
    found = re.sub(r"[-_ ]", "_", text.strip()).upper()
    return ALIASES.get(found, found)


def boolean(value: str) -> bool:
    """Beginnings of true, false, yes, no; on, off, 1, 0."""
    v = value.strip().lower()
    if v and ("true".startswith(v) or "yes".startswith(v)) or v in ("on", "1"):
        return True
    if v and ("false".startswith(v) or "no".startswith(v)) or v in ("off", "of", "0"):
        return False
    raise OptionError(f"{value!r} is not a boolean")


def one_byte(value: str) -> str:
    if len(value.encode()) != 1:
        raise OptionError(f"{value!r} must be a single byte")
    return value


def count(value: str) -> int:
    if value.strip().upper() == "INFINITE" or value.strip() == "-1":
        return INFINITE
    if not re.fullmatch(r"\d+", value.strip()):
        raise OptionError(f"{value!r} is not a count")
    return int(value)


def parse_control(text: str) -> list[tuple[str, str]]:
    """``KEY = VALUE`` lines: ``#`` begins a comment outside quotes, ``"`` quotes, ``\\`` escapes inside quotes."""
    found = []
    for n, line in enumerate(text.splitlines(), 1):
        if len(line.encode()) > 1023:
            raise OptionError(f"line {n} is too long")
        out, quoted, at = [], False, 0
        while at < len(line):
            c = line[at]
            if quoted and c == "\\" and at + 1 < len(line):
                at += 1
                out.append((line[at], True))
            elif c == '"':
                quoted = not quoted
                out.append(("", True))
            elif c == "#" and not quoted:
                break
            else:
                out.append((c, quoted))
            at += 1
        if quoted:
            raise OptionError(f"line {n}: a quote is not closed")
        while out and out[-1] in ((" ", False), ("\t", False)):
            out.pop()
        if not any(c.strip() or q for c, q in out):
            continue
        equals = next((i for i, x in enumerate(out) if x == ("=", False)), None)
        if equals is None:
            raise OptionError(f"line {n}: no '='")
        key = "".join(c for c, _ in out[:equals]).strip()
        rest = out[equals + 1 :]
        while rest and rest[0] in ((" ", False), ("\t", False)):
            rest.pop(0)
        if not key or not rest:
            raise OptionError(f"line {n}: a key and a value are needed")
        found.append((key, "".join(c for c, _ in rest)))
    return found


def with_paths(pairs: list[tuple[str, str]], folder: str) -> list[tuple[str, str]]:
    """Relative file names become relative to ``folder``; not stdin, tables and function calls."""
    kinds = {keyword(k): v.strip().upper() for k, v in pairs if keyword(k) in ("TYPE", "WRITER")}
    found = []
    for k, v in pairs:
        name = keyword(k)
        plain = name == "INPUT" and (v.lower() == "stdin" or kinds.get("TYPE") == "FUNCTION")
        plain |= name == "OUTPUT" and kinds.get("WRITER") != "BINARY"
        found.append((k, v if name not in PATHS or plain or "://" in v else os.path.join(folder, v)))
    return found


@dataclass
class LoadOptions:
    """A checked set of options. Counts that are infinite are ``INFINITE``."""

    TYPE: str = "CSV"
    WRITER: str = "DIRECT"
    MULTI_PROCESS: bool = False
    INPUT: str = ""
    OUTPUT: str = ""
    LOGFILE: str | None = None
    PARSE_BADFILE: str | None = None
    DUPLICATE_BADFILE: str | None = None
    PARSE_ERRORS: int = 0
    DUPLICATE_ERRORS: int = 0
    ON_DUPLICATE_KEEP: str = "NEW"
    TRUNCATE: bool = False
    LIMIT: int = INFINITE
    SKIP: int = 0
    CHECK_CONSTRAINTS: bool = False
    ENCODING: str | None = None
    VERBOSE: bool = False
    #: Time stamps of 19 characters are taken digit by digit, without a check of months, days, hours, minutes and seconds.
    FAST_TIMESTAMP: bool = False
    DELIMITER: str = ","
    QUOTE: str = '"'
    ESCAPE: str = '"'
    NULL: str = ""
    FORCE_NOT_NULL: list[str] = field(default_factory=list)
    FILTER: str | None = None
    #: Layout specifications, each with whether blanks were to be preserved where it stood.
    COL: list[tuple[str, bool]] = field(default_factory=list)
    OUT_COL: list[str] = field(default_factory=list)
    STRIDE: int = 0
    PRESERVE_BLANKS: bool = False


def options_of(pairs: list[tuple[str, str]] | dict[str, str]) -> LoadOptions:
    """Parsed and checked: type and writer first, then what these two allow."""
    pairs = list(pairs.items()) if isinstance(pairs, dict) else pairs
    named = [(keyword(k), v) for k, v in pairs]
    known = {f.name for f in fields(LoadOptions)}
    found, seen = LoadOptions(), set()
    for k, v in sorted(named, key=lambda x: x[0] not in ("TYPE", "WRITER", "MULTI_PROCESS")):
        if k not in known:
            raise OptionError(f"invalid keyword {k}")
        if k in seen and k not in AGAIN | LIST:
            raise OptionError(f"{k} is given twice")
        seen.add(k)
        if k == "TYPE":
            v = {"FIXED": "BINARY"}.get(v.strip().upper(), v.strip().upper())
            if v not in BY_TYPE:
                raise OptionError(f"invalid TYPE {v}")
            found.TYPE = v
        elif k == "WRITER":
            v = v.strip().upper()
            if v not in ("DIRECT", "BUFFERED", "BINARY", "PARALLEL"):
                raise OptionError(f"invalid WRITER {v}")
            found.MULTI_PROCESS |= v == "PARALLEL"
            found.WRITER = "DIRECT" if v == "PARALLEL" else v
        elif k == "COL":
            found.COL.append((v, found.PRESERVE_BLANKS))
        elif k in LIST:
            getattr(found, k).append(v)
        elif isinstance(getattr(found, k), bool):
            setattr(found, k, boolean(v))
        elif isinstance(getattr(found, k), int):
            setattr(found, k, count(v))
        elif k in ("DELIMITER", "QUOTE", "ESCAPE"):
            setattr(found, k, one_byte(v))
        elif k == "ON_DUPLICATE_KEEP":
            if v.strip().upper() not in ("NEW", "OLD"):
                raise OptionError(f"invalid ON_DUPLICATE_KEEP {v}")
            found.ON_DUPLICATE_KEEP = v.strip().upper()
        else:
            setattr(found, k, v)
    allowed = COMMON | BY_TYPE[found.TYPE] | BY_WRITER[found.WRITER]
    if wrong := sorted(seen - allowed):
        raise OptionError(f"{wrong[0]} can't be used with TYPE={found.TYPE}, WRITER={found.WRITER}")
    for k in ("INPUT", "OUTPUT"):
        if not getattr(found, k):
            raise OptionError(f"{k} is required")
    if found.TYPE == "CSV":
        if found.DELIMITER in found.NULL or found.QUOTE in found.NULL:
            raise OptionError("the null string holds the delimiter or the quote")
        if found.FORCE_NOT_NULL and found.FILTER:
            raise OptionError("FORCE_NOT_NULL can't be used with FILTER")
    if found.TYPE == "BINARY" and not found.COL:
        raise OptionError("at least one COL is required")
    if found.WRITER == "BINARY" and not found.OUT_COL:
        raise OptionError("at least one OUT_COL is required")
    if found.TYPE in ("CSV", "BINARY") and found.INPUT.lower() != "stdin" and not (os.path.isabs(found.INPUT) or "://" in found.INPUT):
        raise OptionError("INPUT must be stdin or an absolute path")
    must_differ(found)
    return found


def must_differ(options: LoadOptions) -> None:
    """No two of input, output, log and reject files may be one place, however it is written."""
    names = ("INPUT", "OUTPUT", "LOGFILE", "PARSE_BADFILE", "DUPLICATE_BADFILE")
    used = [os.path.normpath(re.sub("^file:/+", "/", getattr(options, k))) for k in names if getattr(options, k)]
    if len(set(used)) < len(used):
        raise OptionError("input, output, log and reject files must differ")


def with_reports(options: LoadOptions, folder: str, now: float) -> LoadOptions:
    """Log and reject files that aren't named get names in ``folder``: the time, the output's name, and what they are."""
    start = os.path.join(folder, f"{time.strftime('%Y%m%d%H%M%S', time.localtime(now))}_{os.path.basename(options.OUTPUT.rstrip('/'))}")
    kind = ".dat" if options.TYPE == "BINARY" else ".csv"
    names = {"LOGFILE": f"{start}.log", "PARSE_BADFILE": f"{start}.prs{kind}"}
    if options.WRITER != "BINARY":
        names["DUPLICATE_BADFILE"] = f"{start}.dup.csv"
    found = replace(options, **{k: getattr(options, k) or v for k, v in names.items()})
    must_differ(found)
    return found


def echo(options: LoadOptions) -> str:
    """The options as a log shows them."""
    lines = []
    for f in fields(LoadOptions):
        value = getattr(options, f.name)
        if value is None or value == [] or f.name == "PRESERVE_BLANKS":
            continue
        for v in value if isinstance(value, list) else [value]:
            v = v[0] if isinstance(v, tuple) else "INFINITE" if v == INFINITE and not isinstance(v, bool) else v
            v = ("YES" if v else "NO") if isinstance(v, bool) else str(v)
            lines.append(f"{f.name} = " + (v if re.fullmatch(r"[\w./:-]+", v) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'))
    return "\n".join(lines) + "\n"
