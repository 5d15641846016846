"""Column expressions of the normalize, rank, gate and report steps; all built-in, none per-row Python."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The date from which commands have the newer form, and the parts of the older form around commit and path (fixed values).
PRE_EPOCH = "2020-03-26 00:00:00"
LEGACY = "nix-shell -p '(import (builtins.fetchTarball \"https://github.com/NixOS/nixpkgs/archive/", '.tar.gz") {}).'
ALLOW = "NIXPKGS_ALLOW_INSECURE=1 "
#: Words that cannot stand as plain identifiers (fixed values).
KEYWORDS = ("assert", "else", "if", "in", "inherit", "let", "or", "rec", "then", "with")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def has_prefix(c: Column, prefix: Column) -> Column:
    """Literal prefix, A-Z regardless of case."""
    return F.startswith(ascii_lower(c), ascii_lower(prefix))


def depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("."), F.lit("")))).cast("bigint")


def short_hash(h: Column) -> Column:
    return F.substring(h, 1, 7)


def path_segments(path: Column) -> Column:
    """Dotted path as segments; quotes hide dots and a backslash in quotes makes the next character literal."""
    found = F.regexp_extract_all(F.concat(path, F.lit(".")), F.lit(r'((?:"(?:[^"\\]|\\.)*"|[^".])*)\.'), 1)
    return F.transform(found, lambda s: F.regexp_replace(F.regexp_replace(s, r"\\(.)", "$1"), '^"|(?<!\\\\)"$', ""))


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def version_of(name: Column, version: Column) -> Column:
    """The version field, or what follows the name's first ``-<digit>``; else null."""
    return F.coalesce(F.nullif(version, F.lit("")), F.nullif(F.regexp_extract(name, r"^.*?-([0-9].*)$", 1), F.lit("")))


def text_of(v: Column, path: str = "$") -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def _items(v: Column) -> Column:
    """A variant that may be one thing or a list of things, as an array of variants."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v)))


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _named(v: Column, keys: tuple[str, ...]) -> Column:
    """Strings of a list or single value: plain strings, or an object's first non-empty field of ``keys``; empty is null."""
    one = lambda x: F.when(_is_string(x), text_of(x)).when(_is_object(x), F.coalesce(*[text_of(x, f"$.{k}") for k in keys]))
    found = F.filter(F.transform(_items(v), one), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, found)


def licenses(v: Column) -> Column:
    return _named(v, ("spdxId", "shortName", "fullName"))


def maintainers(v: Column) -> Column:
    return _named(v, ("github", "name", "email"))


def platforms(v: Column) -> Column:
    return _named(v, ("system",))


def homepage(v: Column) -> Column:
    return F.coalesce(F.when(_is_string(v), text_of(v)), F.element_at(F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: text_of(x)), lambda s: s.isNotNull()), 1))


def source_path(position: Column) -> Column:
    """Without ``:line``, from the first ``pkgs/``, else from the first ``nixos/``, else null."""
    plain = F.regexp_replace(position, ":[0-9]*$", "")
    cut = lambda mark: F.when(F.instr(plain, mark) > 0, plain.substr(F.instr(plain, mark), F.length(plain)))
    return F.coalesce(cut("pkgs/"), cut("nixos/"))


def decode_array(c: Column) -> Column:
    """Text of a JSON array, tolerantly: blank, ``null`` and ``None`` are empty, nulls are dropped, other items become text;
    what is no array is one item as it stands."""
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda x: ~F.is_variant_null(x)), lambda x: F.coalesce(F.when(_is_string(x), F.try_variant_get(x, "$", "string")), F.to_json(x)))
    return F.when(c.isNull() | F.trim(c).isin("", "null", "None"), F.array().cast("array<string>")).when(items.isNotNull(), texts).otherwise(F.array(c))


def insecure(c: Column) -> Column:
    """The row's advisory text has something in it."""
    return F.coalesce(~c.isin("", "[]", "null"), F.lit(False))


def shown(array: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(array, ", "), F.lit("")), F.lit("-"))


def numeric_parts(version: Column) -> Column:
    """Leading digits of the parts between ``. - _ +``, up to the first part without; 64-bit overflow is dropped."""
    digits = F.transform(F.split(version, r"[.\-_+]"), lambda p: F.regexp_extract(p, r"^([0-9]*)", 1))
    stop = F.array_position(digits, "")
    cut = F.when(stop > 0, F.slice(digits, F.lit(1), (stop - 1).cast("int"))).otherwise(digits)
    return F.filter(F.transform(cut, lambda d: d.try_cast("bigint")), lambda n: n.isNotNull())


def family(version: Column) -> Column:
    """``a.b``, or ``a``, or the leading letters and digits."""
    n = numeric_parts(version)
    return F.when(F.size(n) >= 2, F.concat_ws(".", n[0].cast("string"), n[1].cast("string"))).when(F.size(n) == 1, n[0].cast("string")).otherwise(F.regexp_extract(version, "^([A-Za-z0-9]*)", 1))


SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-((?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?$"


def semver_key(version: Column) -> Column:
    """Sort key: valid semantic versions first by precedence, others after by text."""
    part = lambda i: F.regexp_extract(version, SEMVER, i).try_cast("decimal(20,0)")
    pre = F.regexp_extract(version, SEMVER, 4)
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    ids = F.when(pre == "", F.array().cast("array<struct<kind:int,num:decimal(20,0),txt:string>>")).otherwise(F.transform(F.split(pre, r"\."), lambda x: F.struct(F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), number(x).alias("num"), x.alias("txt"))))
    valid = version.rlike(SEMVER)
    return F.struct(F.when(valid, 0).otherwise(1).alias("bad"), part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), F.when(pre == "", 1).otherwise(0).alias("release"), ids.alias("pre"), F.when(valid, F.regexp_extract(version, SEMVER, 5)).otherwise(version).alias("rest"))


def snapshot_name_part(name: Column, part: str) -> Column:
    """``count`` or ``rev`` of ``(nixpkgs|nixos)-VER(pre|beta|.)COUNT.REV``; else null."""
    pattern = r"^(?:nixpkgs|nixos)-[0-9]*\.[0-9]*(?:pre|beta|\.)([0-9]+)\.([0-9a-fA-F]+)$"
    return F.nullif(F.regexp_extract(name, pattern, {"count": 1, "rev": 2}[part]), F.lit(""))


def channel_prefix(channel: Column) -> Column:
    """Where a channel's snapshots are stored; the query fails at a channel that has no known place."""
    known = F.when(channel == "nixpkgs-unstable", F.lit("nixpkgs/")).when(channel.startswith("nixos-"), F.concat(F.lit("nixos/"), F.substring(channel, 7, 1000), F.lit("/")))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown channel "), channel)))


def backoff_seconds(attempts: Column) -> Column:
    """3600 doubled with each attempt after the first, 16 times at most."""
    return F.lit(3600).cast("bigint") * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(16))).cast("bigint")


def date_arg(s: Column) -> Column:
    """A date argument: RFC 3339, or ``yyyy-MM-dd`` at midnight UTC; null stays null and anything else fails the query."""
    full = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(s))
    found = F.coalesce(full, F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))))
    return F.when(s.isNotNull(), F.coalesce(found, F.raise_error(F.concat(F.lit("not a date: "), s)))).cast("timestamp_ntz")


def upper_bound(prefix: Column) -> Column:
    """The least text above all with this prefix: its last character plus one; null if there is none (empty, or the last code point before a gap or the end)."""
    last = F.right(prefix, F.lit(1))
    code = F.conv(F.hex(F.encode(last, "UTF-32")), 16, 10).cast("int")
    # the code point as UTF-8 bytes, as SQL's char() stops at 255
    def octets(c: Column) -> Column:
        six = lambda shift: F.lit(0x80).bitwiseOR(F.shiftright(c, shift).bitwiseAND(F.lit(0x3F)))
        byte = lambda x: F.lpad(F.hex(x), 2, "0")
        return F.when(c < 0x80, byte(c)).when(c < 0x800, F.concat(byte(F.shiftright(c, 6) + 0xC0), byte(six(0)))).when(c < 0x10000, F.concat(byte(F.shiftright(c, 12) + 0xE0), byte(six(6)), byte(six(0)))).otherwise(F.concat(byte(F.shiftright(c, 18) + 0xF0), byte(six(12)), byte(six(6)), byte(six(0))))

    next_one = F.decode(F.unhex(octets(code + 1)), "UTF-8")
    return F.when((F.length(prefix) > 0) & ~code.isin(0xD7FF, 0x10FFFF), F.concat(F.left(prefix, F.length(prefix) - 1), next_one))


def commit_label(sha: Column) -> Column:
    """Name of a snapshot that was taken from a commit itself."""
    return F.concat(F.lit("master-"), F.substring(sha, 1, 12))


def micros_to_millis(micros: Column) -> Column:
    """Milliseconds of microseconds that saturate at 32 bits."""
    return F.least(micros, F.lit(4294967295)) / 1000.0


def encode_array(c: Column) -> Column:
    """JSON array of texts; a null or empty array is null."""
    return F.when(F.size(c) > 0, F.to_json(c))


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two texts share, A-Z regardless of case."""
    letters = lambda c: F.split(ascii_lower(c), "")
    stop = F.array_position(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, 1).otherwise(0)), 0)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(stop > 0, stop - 1).otherwise(F.least(F.length(a), F.length(b))).cast("bigint")


def quoted_path(path: Column) -> Column:
    """Dotted path with segments quoted that aren't plain identifiers."""
    plain = lambda s: s.rlike(r"^[A-Za-z_][A-Za-z0-9_'-]*$") & ~s.isin(*KEYWORDS)
    quote = lambda s: F.concat(F.lit('"'), F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.array_join(F.transform(F.split(path, r"\."), lambda s: F.when(plain(s), s).otherwise(quote(s))), ".")


def usage_command(path: Column, commit: Column, last: Column, is_insecure: Column, run: bool = False) -> Column:
    """How to get (or ``run``) a version: the older form before the epoch date, the newer one after it."""
    old = last < F.lit(PRE_EPOCH).cast("timestamp_ntz")
    quoted = quoted_path(path)
    allow = F.when(is_insecure, ALLOW).otherwise("")
    legacy = F.concat(allow, F.lit(LEGACY[0]), commit, F.lit(LEGACY[1]), quoted, F.lit("'"), *([F.lit(" --run "), path] if run else []))
    ref = F.concat(F.lit("nixpkgs/"), commit, F.lit("#"), quoted)
    ref = F.when(quoted.contains('"'), F.concat(F.lit("'"), ref, F.lit("'"))).otherwise(ref)
    modern = F.concat(allow, F.lit("nix run" if run else "nix shell"), F.when(is_insecure, " --impure").otherwise(""), F.lit(" "), ref)
    return F.when(old, legacy).otherwise(modern)


def request_parts(q: Column) -> tuple[Column, Column]:
    """Free text as (name, version): a last word ``v?digit...`` is a version unless what stands before it ends in a digit."""
    pattern = r"(?i)^(.+?)\s+(v?[0-9][0-9.]*[A-Za-z0-9_.-]*)$"
    name = F.regexp_extract(F.trim(q), pattern, 1)
    split = (name != "") & ~name.rlike("[0-9]$")
    return F.when(split, F.trim(name)).otherwise(F.trim(q)), F.when(split, F.regexp_replace(F.regexp_extract(F.trim(q), pattern, 2), "^[vV]", ""))
