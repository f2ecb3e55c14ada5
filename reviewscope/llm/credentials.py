"""Secret scan with multipart credential linking, native DataFrame operations only.

Six kinds of parts are looked for in the whole text, each leftmost and without overlaps of its own kind. Three are strong and always
reported: assignments of a secret, access identifiers and long hexadecimal strings. Three are weak: names of a login,
opaque strings that mix digits and both cases, and endpoints. A weak part is reported only if a complementary part
begins within `SCOPE` characters of it: a login or an endpoint needs a secret (assign, hex, opaque), an opaque string
needs an identifier (access, login).

Positions come from the lengths of the matches and of the gaps between them. The linking is an interval join: parts
of one text, in order of their start, look into a range of SCOPE characters to both sides. Only texts with complementary
parts anywhere take part, each distinct text once, and a group of the window is one text.

Every pattern is matched without recursion and every step is linear in the text (but for 1 / `WALK` of the squared number of its
matches, copied as references), so texts of megabytes of nothing but matches are fine.

Edge cases: a null text counts as empty and has no spans. Rows that repeat are reported each on its own. Parts that
start at one place are ordered by kind, in the order of `KINDS`. Null keys are kept as null. Empty tables give empty results;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewscope.session import stored

SCOPE = 256
WALK = 128


class Kind(NamedTuple):
    name: str
    pattern: str
    role: str
    strong: bool
    #: Which matches count: (group to look at, expressions that it must match).
    group: int
    needs: tuple[str, ...]


# The first three patterns and lengths are given.
KINDS = (
    Kind("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "secret", True, 2, ("^.{6}",)),
    Kind("access", r"AKIA[A-Z0-9]+", "id", True, 0, ("^.{20}",)),
    Kind("hex", r"[0-9a-f]+", "secret", True, 0, ("^.{24}",)),
    Kind("login", r"(?i:(username|user|login|client_?id|account_?id|access_?id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)", "id", False, 2, ("^.{3}",)),
    Kind("opaque", r"[A-Za-z0-9+/_-]+", "secret", False, 0, ("^.{20}", "[0-9]", "[a-z]", "[A-Z]")),
    Kind("endpoint", r"(https?://[^\x09-\x0D\x20\"'<>]+|(?i:(host|server|endpoint))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)++)", "endpoint", False, 0, ()),
)
#: Cheap tests that a text with a match of the kind passes. None of them runs twice over one stretch of text.
HINTS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
    "login": r"(?i:username|user|login|client_?id|account_?id|access_?id)[\"']?\x20*[:=]",
    "opaque": "[A-Za-z0-9+/_-]{20}",
    "endpoint": r"://|(?i:host|server|endpoint)[\"']?\x20*[:=]",
}
WEAK = tuple(k.name for k in KINDS if not k.strong)


def once(value: Column, body) -> Column:
    """`body` of a value that is evaluated a single time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, kind: Kind) -> Column:
    """Array of (start, kind, end) of the matches that count; code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    judged = F.regexp_extract_all(text, F.lit(kind.pattern), kind.group)
    gaps = F.split(text, kind.pattern, -1)
    place = KINDS.index(kind)

    def fits(value: Column) -> Column:
        out = F.lit(True)
        for need in kind.needs:
            out = out & value.rlike(need)
        return out

    rows = F.arrays_zip(
        F.transform(matches, F.length).alias("size"), F.transform(gaps, F.length).alias("gap"), F.transform(judged, fits).alias("fits")
    )
    empty = F.array().cast("array<struct<start:int,place:int,end:int>>")

    def walk(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        found = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), (start + row["size"]).alias("end")))
        return F.struct(
            (start + F.coalesce(row["size"], F.lit(0))).alias("at"),
            F.when(F.coalesce(row["fits"], F.lit(False)), F.concat(state["found"], found)).otherwise(state["found"]).alias("found"),
        )

    def stretches(rows: Column) -> Column:
        """What each `WALK` matches show, and how many characters they span."""
        start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
        steps = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(WALK))
        return F.transform(steps, lambda at: F.aggregate(F.slice(rows, at, F.lit(WALK)), start, walk))

    def shifted(state: Column, one: Column) -> Column:
        found = F.transform(one["found"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["place"].alias("place"), (s["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + one["at"]).alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    # A growing array is copied at each step, so matches are walked through in stretches, and these one after the other.
    nested = F.array().cast("array<array<struct<start:int,place:int,end:int>>>")
    walked = F.flatten(F.aggregate(once(rows, stretches), F.struct(F.lit(0).alias("at"), nested.alias("found")), shifted, lambda s: s["found"]))
    return F.when(text.rlike(HINTS[kind.name]), walked).otherwise(empty)


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(
        F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["place"] + 1), s["start"], s["end"])), ","
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """For every row: key, n_assign, n_access, n_hex, base (strong spans), spans (all of them) and n_linked."""
    whole = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = whole.select("key", "text", *(spans(F.col("text"), k).alias(k.name) for k in KINDS))
    some = {role: F.lit(False) for role in ("id", "secret", "endpoint")}
    for k in KINDS:
        some[k.role] = some[k.role] | (F.size(k.name) > 0)
    weak = F.lit(False)
    for name in WEAK:
        weak = weak | (F.size(name) > 0)
    complementary = weak & some["secret"] & (some["id"] | some["endpoint"])
    found = stored(
        found.select(
            "key",
            *(k.name for k in KINDS if k.strong),
            F.when(complementary, F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
            F.when(complementary, F.concat(*WEAK)).alias("weak"),
        ),
        "credential-parts",
    )
    strong = F.concat(*(k.name for k in KINDS if k.strong))
    own = found.select("key", *(F.size(k.name).cast("bigint").alias(f"n_{k.name}") for k in KINDS if k.strong), "digest", strong.alias("strong"))
    joined = own.join(linked(found, strong, scope), "digest", "left")
    more = F.coalesce("linked", F.array().cast("array<struct<start:int,place:int,end:int>>"))
    return joined.select(
        F.col("key").alias(key),
        *(f"n_{k.name}" for k in KINDS if k.strong),
        listed(F.col("strong")).alias("base"),
        listed(F.concat("strong", more)).alias("spans"),
        F.size(more).cast("bigint").alias("n_linked"),
    )


def linked(found: DataFrame, strong: Column, scope: int) -> DataFrame:
    """digest, linked: the weak parts of each text that have a complementary part in reach."""
    texts = found.filter("digest is not null").groupBy("digest").agg(F.first(F.concat(strong, "weak")).alias("parts"))
    parts = texts.select("digest", F.explode("parts").alias("part")).select("digest", "part", "part.start", "part.place")
    reach = W.partitionBy("digest").orderBy("start").rangeBetween(-scope, scope)

    def is_(*roles: str) -> Column:
        return F.col("place").isin([i for i, k in enumerate(KINDS) if k.role in roles])

    near = parts.withColumn("near_secret", F.max(is_("secret")).over(reach)).withColumn("near_id", F.max(is_("id")).over(reach))
    weak = F.col("place").isin([i for i, k in enumerate(KINDS) if not k.strong])
    near = near.filter(weak & ((is_("id", "endpoint") & F.col("near_secret")) | (is_("secret") & F.col("near_id"))))
    return stored(near.groupBy("digest").agg(F.collect_list("part").alias("linked")), "credential-links")
