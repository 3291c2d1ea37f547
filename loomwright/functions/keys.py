"""Keys, hashes and canonical names as column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def sha_hex(c: Column, prefix: bool = False) -> Column:
    """SHA-256 of a text or bytes in hex; with ``sha256:`` before it if wanted. Null stays null."""
    h = F.sha2(c, 256)
    return F.concat(F.lit("sha256:"), h) if prefix else h


def nul_joined(*parts: Column | str) -> Column:
    """The parts as text with NUL between them; null if any is null."""
    out: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            out.append(F.lit(NUL))
        out.append(F.lit(p) if isinstance(p, str) else p.cast("string"))
    return F.concat(*out)


def json_array(*parts: Column | str | int) -> Column:
    """Compact JSON of an array of strings and whole numbers, characters above ASCII as they are."""
    out: list[Column] = [F.lit("[")]
    for i, p in enumerate(parts):
        if i:
            out.append(F.lit(","))
        if isinstance(p, int):
            out.append(F.lit(str(p)))
        else:
            text = F.to_json(F.array(F.lit(p) if isinstance(p, str) else p))
            out.append(F.regexp_replace(text, r"^\[|\]$", ""))
    out.append(F.lit("]"))
    return F.concat(*out)


def canonical_object(fields: dict[str, Column]) -> Column:
    """Compact JSON of an object with sorted keys and all of them present (null as null)."""
    pairs = []
    for k in sorted(fields):
        pairs += [fields[k].alias(k)]
    return F.to_json(F.struct(*pairs), {"ignoreNullFields": "false"})


def first_word(c: Column, digits: int = 8) -> Column:
    """The first ``digits`` hex digits of a hex hash as a whole number."""
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("long")


def bucket_nul(seed: str, group: Column, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 by the SHA-256 of seed NUL group."""
    return first_word(F.sha2(nul_joined(seed, group), 256)) % buckets


def bucket_json(seed: int, group: Column, buckets: int = 100) -> Column:
    """Bucket by the SHA-256 of the JSON array [seed, group]; other buckets than ``bucket_nul``."""
    return first_word(F.sha2(json_array(seed, group), 256)) % buckets


def seed31(*parts: Column | str) -> Column:
    """A 31-bit seed: the first four octets of the NUL-joined parts' hash, without the sign bit."""
    return first_word(F.sha2(nul_joined(*parts), 256)).bitwiseAND(F.lit(0x7FFFFFFF))


def canonical_repository(c: Column) -> Column:
    """``host/owner/repo`` in lower case from a URL, an scp form or a plain name; the last three parts; else null."""
    x = F.lower(F.trim(c))
    x = F.regexp_replace(x, r"^[a-z+]+://(?:[^/@]*@)?", "")
    x = F.regexp_replace(x, r"^git@([^:/]+):", "$1/")
    x = F.regexp_replace(F.regexp_replace(x, r"^/+|/+$", ""), r"\.git$", "")
    parts = F.split(x, "/")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, -3, 3), "/"))


def single_repository(c: Column, host: str) -> Column:
    """The canonical name of a comma list with exactly one entry (``owner/repo`` is taken to be at ``host``)."""
    entries = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    one = F.when(F.size(entries) == 1, entries[0])
    short = F.when(one.rlike(r"^[^/:\s]+/[^/:\s]+$"), F.concat(F.lit(host + "/"), F.regexp_replace(F.lower(one), r"\.git$", "")))
    return F.coalesce(short, canonical_repository(one))


def bare_name(c: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def path_parts(c: Column) -> Column:
    """Parts of a relative path, without empty ones and single dots."""
    return F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))


def file_suffix(c: Column) -> Column:
    """The last ``.x`` of the file name, or an empty text."""
    return F.regexp_extract(F.element_at(F.split(c, "/"), -1), r"(?<=.)(\.[^./]+)$", 1)


def is_safe_path(c: Column) -> Column:
    """A relative path that stays inside its root: not null or empty, no back slash, NUL, drive or ``..`` part."""
    parts = path_parts(c)
    good = (F.length(c) > 0) & ~c.startswith("/") & ~c.contains("\\") & ~c.contains(NUL) & ~c.rlike("^[A-Za-z]:")
    return F.coalesce(good & (F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.lit(False))


def closing_references(text: Column, own: Column) -> Column:
    """Sorted distinct issue numbers that a text says it closes, of its own repository (``owner/repo``) only."""
    pattern = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b\s*:?\s*(?:([\w.-]+/[\w.-]+))?#(\d+)\b"
    repos = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    mine = F.filter(F.arrays_zip(repos.alias("r"), numbers.alias("n")), lambda x: (x["r"] == "") | (F.lower(x["r"]) == F.lower(own)))
    return F.array_sort(F.array_distinct(F.transform(mine, lambda x: x["n"].cast("long"))))


def _starts_with(prefix: str) -> Callable[[Column], Column]:
    return lambda w: w.startswith(prefix)


def keyword_hit(text: Column, words: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """Whether a word of the text is one of ``words`` or starts with one of ``prefixes``."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))
    hit = F.arrays_overlap(found, F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    for p in prefixes:
        hit = hit | F.exists(found, _starts_with(p))
    return F.coalesce(hit, F.lit(False))


def token_estimate(*texts: Column, base: int = 512) -> Column:
    """(octets of all texts + base) div 4; a null text has none."""
    total = F.lit(base).cast("long")
    for t in texts:
        total = total + F.coalesce(F.octet_length(t), F.lit(0))
    return F.floor(total / 4).cast("long")


def rate(count: Column, total: Column) -> Column:
    """count / total, and 0.0 of nothing."""
    return F.when(total > 0, count / total).otherwise(0.0)


def ascii_json(text: Column) -> Column:
    """JSON text with every character that isn't printable ASCII as ``\\uXXXX``, one for each 16-bit unit."""
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(text, "UTF-16BE"))), F.lit("[0-9a-f]{4}"), F.lit(0))
    plain = lambda u: F.char(F.conv(u, 16, 10).cast("int"))
    escaped = F.array_join(F.transform(units, lambda u: F.when(u <= "007e", plain(u)).otherwise(F.concat(F.lit("\\u"), u))), "")
    # only texts with such characters are taken apart
    return F.when((F.octet_length(text) == F.char_length(text)) & ~text.contains("\x7f"), text).otherwise(escaped)


def has_part(path: Column, names: Sequence[str]) -> Column:
    """Whether a folder of the path bears one of the names, case ignored; the file's own name doesn't count."""
    parts = path_parts(path)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda x: F.lower(x).isin(*[n.lower() for n in names]))


def is_named(path: Column, names: Sequence[str], suffixes: Sequence[str]) -> Column:
    """Whether the file has one of the names, or one of the suffixes (case ignored)."""
    return F.element_at(F.split(path, "/"), -1).isin(*names) | F.lower(file_suffix(path)).isin(*[x.lower() for x in suffixes])


def record_url(url: Column, host: str, kind: str) -> Column:
    """(repository, number) of an ``https`` address ``host/owner/repo/kind/number``, and of no other; else null."""
    pattern = rf"^https://{host.replace('.', '[.]')}/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)/{kind}/([1-9][0-9]*)/?$"
    repo, number = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.when(url.rlike(pattern), F.struct(F.concat(F.lit(f"{host}/"), F.lower(repo)).alias("repository"), number.cast("long").alias("number")))


def sampling_family(group: Column, path: Column, symbol: Column, anchor: Column) -> Column:
    """``group|path|symbol`` in lower case, with the anchor's hash where there is no symbol; null if neither is there or
    the path isn't safe."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(path, r"\\\\", "/"), "^/+|/+$", ""))
    told = F.nullif(F.lower(F.trim(F.coalesce(symbol, F.lit("")))), F.lit(""))
    tail = F.coalesce(told, F.when(anchor.rlike("^sha256:[0-9a-f]{64}$"), anchor))
    good = (clean != "") & ~F.array_contains(F.split(clean, "/"), "..")
    return F.when(good & tail.isNotNull(), F.concat_ws("|", group, clean, tail))


def by_alias(c: Column, aliases: dict[str, str]) -> Column:
    """The name that a value is an alias of, trimmed and case ignored; null for other values."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(c)))


def exact_fields(raw: Column, fields: dict[str, str]) -> Column:
    """Why a JSON object hasn't exactly these fields of these kinds, or null: ``json``, ``fields`` or ``kinds``.

    Kinds are those of ``schema_of_variant``, as ``STRING`` or ``BIGINT``.
    """
    doc = F.try_parse_json(raw)
    names = F.json_object_keys(raw)
    kinds = F.lit(True)
    for n, kind in fields.items():
        kinds = kinds & (F.schema_of_variant(F.try_variant_get(doc, f"$.{n}", "variant")) == kind)
    return F.when(doc.isNull() | names.isNull(), "json").when(F.array_sort(names) != F.array(*[F.lit(n) for n in sorted(fields)]), "fields").when(~F.coalesce(kinds, F.lit(False)), "kinds")
