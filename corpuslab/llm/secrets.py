"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every match of a pattern is put between marks, the text is split at the marks, and running lengths give
the spans in code points. Base spans are those of three fixed patterns. The method adds spans of a
further kind, ``live``: long tokens of mixed characters outside the base spans whose hash is not widely copied in
the whole corpus. An owner is a source, a repository a document. A value is widely copied when two or more
owners hold it, or one owner in very many repositories: a token that a source repeats in hundreds of its
documents is boilerplate, not one key that leaked. The same counts tell base values apart. Only candidates
are shuffled, with partial sums per hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import saved, text_of

#: Fixed patterns of the base kinds, in the order in which they are listed; letters of a keyword in either case.
KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
PATTERNS = {
    "assign": KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "live": "[A-Za-z0-9+/_-]+",
}
#: The part of a match that must be long enough, and how long.
VALUE = {"assign": "^" + KEYWORD + r"""["']?\x20*[:=]\x20*["']?""", "access": "^", "hex": "^", "live": "^"}
LEAST = {"assign": 8, "access": 16, "hex": 32, "live": 24}
BASE = ("assign", "access", "hex")
#: Owners, and repositories of a single owner, from which on a value counts as widely copied.
COPIED, COPIED_REPOSITORIES = 2, 100
#: Stand around a match; a text that holds the first has it replaced by a character no pattern takes.
MARK, OTHER = "\ue000", "\ue001"

_SPAN = "struct<kind: string, nr: int, lo: int, hi: int, value: string>"


def spans(text: Column, kind: str) -> Column:
    """Array of the leftmost matches that do not overlap, failing ones dropped: kind, nr, lo, hi, value."""
    nr = list(PATTERNS).index(kind)
    clean = F.translate(text, MARK, OTHER)
    # Every second part is a match. Its start is the length of all parts before it.
    parts = F.split(F.regexp_replace(clean, f"({PATTERNS[kind]})", f"{MARK}$1{MARK}"), MARK)
    numbered = F.aggregate(
        parts,
        F.expr(f"named_struct('odd', false, 'at', 0, 'out', cast(array() as array<{_SPAN}>))"),
        lambda acc, part: F.struct(
            (~acc["odd"]).alias("odd"),
            (acc["at"] + F.length(part)).alias("at"),
            F.when(
                acc["odd"] & _passes(part, kind),
                F.array_append(
                    acc["out"],
                    F.struct(F.lit(kind).alias("kind"), F.lit(nr).alias("nr"), acc["at"].alias("lo"), (acc["at"] + F.length(part)).alias("hi"), _value(part, kind).alias("value")),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.rlike(text, F.lit(_quick(kind))), numbered).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _quick(kind: str) -> str:
    """Holds for every text with a passing match; spares the others the marks."""
    if kind == "assign":
        return PATTERNS[kind]
    head = {"access": "AKIA[A-Z0-9]", "hex": "[0-9a-f]", "live": "[A-Za-z0-9+/_-]"}[kind]
    return head + "{" + str(LEAST[kind] - (4 if kind == "access" else 0)) + "}"


def _value(part: Column, kind: str) -> Column:
    return F.regexp_replace(part, VALUE[kind], "") if kind == "assign" else part


def _passes(part: Column, kind: str) -> Column:
    long_enough = F.length(_value(part, kind)) >= LEAST[kind]
    if kind != "live":
        return long_enough
    # Mixed characters make a candidate; how often it occurs decides.
    return long_enough & F.rlike(part, F.lit("[0-9]")) & F.rlike(part, F.lit("[a-z]")) & F.rlike(part, F.lit("[A-Z]"))


def ownership(found: DataFrame) -> DataFrame:
    """``digest, owners, repositories`` of candidate values; distinct pairs are formed before they are counted."""
    pairs = found.select("digest", "owner", "at").groupBy("digest", "owner").agg(F.count_distinct("at").alias("n"))
    return pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def is_copied(owners: Column, repositories: Column, copied: int = COPIED, copied_repositories: int = COPIED_REPOSITORIES) -> Column:
    return (owners >= copied) | (repositories >= copied_repositories)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", copied: int = COPIED, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """``doc_id, spans`` for every row: an array of kind, nr, lo, hi, owners, repositories in order of lo, then kind.

    A null text is empty and has no span; rows without an owner share one. Repeated rows are scanned one by
    one and count as one repository each. No rows give no rows. Base spans are all returned, with the
    numbers of owners and repositories that hold the value; of the further kind only those that no base span
    touches and whose value has fewer than ``copied`` owners and ``copied_repositories`` repositories.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), text_of(text_col).alias("_text"))
    rows = saved(rows.select("doc_id", F.coalesce("owner", F.lit("")).alias("owner"), F.monotonically_increasing_id().alias("at"), *[spans(text, k).alias(k) for k in PATTERNS]))
    base = F.concat(*[F.col(k) for k in BASE])
    free = F.filter("live", lambda s: ~F.exists(base, lambda b: (b["lo"] < s["hi"]) & (s["lo"] < b["hi"])))
    found = saved(rows.select("at", "owner", F.explode(F.concat(base, free)).alias("span")).withColumn("digest", F.unhex(F.sha2("span.value", 256))))
    counted = found.join(ownership(found), "digest").where((F.col("span.kind") != "live") | ~is_copied(F.col("owners"), F.col("repositories"), copied, copied_repositories))
    span = F.struct(F.col("span.lo").alias("lo"), F.col("span.nr").alias("nr"), F.col("span.hi").alias("hi"), F.col("span.kind").alias("kind"), "owners", "repositories")
    per_row = counted.groupBy("at").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.expr("cast(array() as array<struct<lo: int, nr: int, hi: int, kind: string, owners: bigint, repositories: bigint>>)")
    return rows.select("at", "doc_id").join(per_row, "at", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def _joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")


def per_document(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, all spans with owners and repositories of each, and how many base values are widely copied or how many of all may be live.

    Rows, nulls and empty texts are those of :func:`scan`; a text without spans has empty strings and zeros.
    """
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] != "live")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        "doc_id",
        count(lambda s: s["kind"] == "assign").alias("n_assign"),
        count(lambda s: s["kind"] == "access").alias("n_access"),
        count(lambda s: s["kind"] == "hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.array_join(F.col("spans.owners").cast("array<string>"), ",").alias("owners"),
        F.array_join(F.col("spans.repositories").cast("array<string>"), ",").alias("repositories"),
        count(lambda s: (s["kind"] != "live") & is_copied(s["owners"], s["repositories"])).alias("n_copied"),
        count(lambda s: ~is_copied(s["owners"], s["repositories"])).alias("n_live"),
    )


def _oracle() -> str:
    """The same in DuckDB: matches between marks, offsets as running lengths."""
    parts = []
    for nr, (kind, pattern) in enumerate(PATTERNS.items()):
        head = VALUE[kind].replace("'", "''") if kind == "assign" else "^"
        pattern = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, owner, '{kind}' AS kind, {nr} AS nr, lo, lo + length(part) AS hi, regexp_replace(part, '{head}', '') AS value FROM (
          SELECT doc_id, owner, part, k, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) - length(part) AS lo FROM (
            SELECT doc_id, owner, unnest(p) AS part, unnest(range(len(p))) AS k FROM (
              SELECT doc_id, owner, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS p FROM d)))
        WHERE k % 2 = 1 AND length(regexp_replace(part, '{head}', '')) >= {LEAST[kind]}""")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, replace(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents),
    found AS ({' UNION ALL '.join(parts)}),
    base AS (SELECT * FROM found WHERE kind <> 'live'),
    live AS (SELECT * FROM found f WHERE kind = 'live' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.lo < f.hi AND f.lo < b.hi)),
    candidates AS (SELECT * FROM base UNION ALL SELECT * FROM live),
    owned AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT doc_id) AS repositories FROM candidates GROUP BY value),
    spans AS (SELECT c.*, owners, repositories, owners >= {COPIED} OR repositories >= {COPIED_REPOSITORIES} AS copied, kind || ':' || lo || ':' || hi AS s
      FROM candidates c JOIN owned USING (value) WHERE kind <> 'live' OR NOT (owners >= {COPIED} OR repositories >= {COPIED_REPOSITORIES}))
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      sha256(coalesce(string_agg(s, ',' ORDER BY lo, nr) FILTER (kind <> 'live'), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY lo, nr), '') AS spans,
      coalesce(string_agg(owners, ',' ORDER BY lo, nr), '') AS owners, coalesce(string_agg(repositories, ',' ORDER BY lo, nr), '') AS repositories,
      count(*) FILTER (kind <> 'live' AND copied) AS n_copied, count(*) FILTER (NOT copied) AS n_live
    FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


ORACLE = _oracle()
