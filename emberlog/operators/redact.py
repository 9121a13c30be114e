"""Reversible pseudonyms for identifiers in text columns, JSON texts among them.

The mapping is a DataFrame (value, token, kind, restored): every distinct identifier gets a number of its kind.
Rows are rewritten with the mapping of the identifiers that they hold, so the mapping may be as large as it likes.  It is one table in the shared
folder of checkpoints, which restricts who may read it as it does for the inputs' own checkpoints, and nowhere else; ``forgotten`` deletes it.  What the patterns find is joined by value.  Bare names are found by an inverted index of the texts' words: a name is looked up by that of its words that the
fewest texts have, and tested against the text before anything is grouped.  A text is rewritten in one pass, so that no token is replaced again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.shared import removed, stored
from emberlog.operators import intel

# Identifier patterns; longer ones come first, so that an ARN is one identifier.
_ARN = r"arn:aws(?:-us-gov|-cn)?:[a-z0-9-]+:[a-z0-9-]*:(?:\d{12})?:[^\s\"',]+"
_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
_ACCOUNT = r"(?<!\d)\d{12}(?!\d)"
_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
_LEAD = r"(?i:bucket[\"' :=]{1,3}|bucketName\":\s?\")"  #: stands before the name of a bucket and belongs to the match, so that no other begins inside the name
_BUCKET = rf"{_LEAD}(?!{_ARN}|{_KEY}|{_ACCOUNT}|{_IP})(?i:[a-z0-9][a-z0-9.-]{{2,62}})"
PATTERNS = (("ARN", _ARN), ("KEY", _KEY), ("ACCOUNT", _ACCOUNT), ("IP", _IP), ("BUCKET", _BUCKET))
_ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)


def _identifier(match: Column) -> Column:
    """What a pattern found, without what stands before a bucket."""
    return F.regexp_replace(match, f"^{_LEAD}", "")


def found_in(text: Column) -> Column:
    """The distinct identifiers that the patterns find in a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ANY), F.lit(0)), _identifier))


def _private(ip: Column) -> Column:
    """Addresses of networks that aren't public; multicast ones count as public."""
    return ~intel.routable_ipv4(ip) & ~F.split(ip, r"\.")[0].cast("int").between(224, 239)


def kind_of(value: Column) -> Column:
    arn = value.startswith("arn:aws")
    return (
        F.when(arn & value.contains(":user/"), "PRINCIPAL")
        .when(arn & value.rlike(":(assumed-)?role/"), "ROLE")
        .when(arn & value.contains(":s3:::"), "BUCKET")
        .when(arn & value.contains(":function:"), "FUNCTION")
        .when(arn, "RESOURCE")
        .when(value.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$"), "KEY")
        .when(value.rlike(r"^\d{12}$"), "ACCOUNT")
        .when(value.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), F.when(_private(value), "IP-PRIVATE").otherwise("IP"))
        .otherwise("BUCKET")
    )


def bare_name(arn: Column) -> Column:
    """The name inside a user or role ARN, else null."""
    name = F.when(arn.contains(":assumed-role/"), F.regexp_extract(arn, ":assumed-role/([^/]+)", 1)).when(arn.rlike(":(user|role)/"), F.element_at(F.split(arn, "/"), -1))
    return F.when(F.length(name) >= 3, name)


def mapping(texts: DataFrame, column: str, names: DataFrame | None = None, name_kind: str = "PRINCIPAL") -> DataFrame:
    """(value, token, kind, restored) of all identifiers in a text column, and of bare names (name, and kind where there is one).

    A bare name shares the token of the ARN that holds it; the ARN is what the token is restored to.
    What looks like an address and is none stays as it is.  Tokens are numbered by kind: within slices of the values' hashes, with the slices' sizes added up.
    """
    found = texts.select(F.explode(found_in(F.col(column))).alias("value")).distinct().filter(~F.col("value").rlike(rf"^{_IP}\z") | intel.is_ipv4(F.col("value")))
    arns = found.withColumn("kind", kind_of(F.col("value"))).withColumn("name", bare_name(F.col("value")))
    owned = arns.filter("name IS NOT NULL").groupBy("name").agg(F.min_by(F.struct("value", "kind"), "value").alias("o"))
    bare = owned.select("name", F.col("o.value").alias("owner"), F.col("o.kind").alias("kind"))
    if names is not None:
        own = F.col("kind") if "kind" in names.columns else F.lit(name_kind)
        given = names.filter(F.length("name") >= 3).groupBy("name").agg(F.min(own).alias("__kind"))
        bare = bare.join(given, "name", "full_outer").select("name", F.coalesce("owner", "name").alias("owner"), F.coalesce("kind", "__kind").alias("kind"))
    keys = arns.join(bare.select("name", "owner"), "name", "left").select("value", "kind", F.coalesce("owner", "value").alias("owner"))
    keys = keys.union(bare.select(F.col("name").alias("value"), "kind", "owner"))
    keys = stored(keys, "identifiers")
    named = keys.join(numbered(keys.select("owner", "kind").distinct(), "kind", "owner"), ["owner", "kind"])
    return stored(named.select("value", F.concat_ws("-", "kind", F.col("number").cast("string")).alias("token"), "kind", F.col("owner").alias("restored")).dropDuplicates(["value"]), "mapping")


def forgotten(tokens: DataFrame) -> None:
    """Deletes the table of a mapping; nothing that rests on it can be read any more."""
    removed(tokens)


def numbered(rows: DataFrame, kind: str, value: str, slices: int = 64) -> DataFrame:
    """Adds ``number``: 1, 2, ... within each kind, in the order of slice and value."""
    r = rows.withColumn("__slice", F.pmod(F.xxhash64(value), F.lit(slices)))
    size = r.groupBy(kind, "__slice").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy(kind).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = size.withColumn("__ahead", ahead).drop("__n")
    own = F.row_number().over(Window.partitionBy(kind, "__slice").orderBy(value))
    return r.withColumn("__own", own).join(F.broadcast(size), [kind, "__slice"]).withColumn("number", F.col("__ahead") + F.col("__own")).drop("__slice", "__own", "__ahead")


_OUTSIDE = "[A-Za-z0-9]"  #: bare names stand between other characters than these


def _rewritten(text: Column, pattern: Column, pairs: Column) -> Column:
    """The text with what the pattern finds replaced by the (old, new) pairs; what has no pair stays."""
    known = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["old"], p["new"])))

    def new(match: Column) -> Column:
        bare = _identifier(match)
        lead = F.substring(match, F.lit(1), F.length(match) - F.length(bare))
        return F.coalesce(F.try_element_at(known, match), F.concat(lead, F.try_element_at(known, bare)), match)

    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), new)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")


def _words(text: Column) -> Column:
    """The distinct words of a text: runs of letters and digits, and each other character."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s){_OUTSIDE}+|."), F.lit(0)))


def candidates(rows: DataFrame, key: str, column: str, names: DataFrame) -> DataFrame:
    """(key, old, new) of names (old, new) whose rarest word a text has.

    A name stands between other characters than letters and digits, so a text that holds it has all its words.  Only words of names are indexed; a name with
    a word that no text has is looked up nowhere.
    """
    spelt = names.select("old", "new", F.explode(_words(F.col("old"))).alias("word"))
    index = rows.select(F.col(key), F.explode(_words(F.col(column))).alias("word")).join(spelt.select("word").distinct(), "word", "left_semi")
    spelt = spelt.join(index.groupBy("word").agg(F.count("*").alias("texts")), "word", "left")
    rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), (-F.length("word")).alias("long"), "word"))
    probes = spelt.groupBy("old", "new").agg(rarest.alias("p")).filter("p.texts > 0").select("old", "new", F.col("p.word").alias("word"))
    return index.join(probes, "word").select(key, "old", "new")


def _by_shuffle(rows: DataFrame) -> DataFrame:
    """Rows that a join must not send whole to every task: they are as many as the texts, but Spark guesses their size by that of compressed files."""
    return rows.hint("merge")


def _with_pairs(rows: DataFrame, key: str, each: DataFrame) -> DataFrame:
    """Adds ``__pairs``, the longest first, out of each (key, old, new, bare)."""
    each = each.groupBy(key, "old").agg(F.max("new").alias("new"), F.max("bare").alias("bare"))
    order = F.struct((-F.length("old")).alias("long"), "old", "new", "bare")
    return rows.join(_by_shuffle(each.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("__pairs"))), key, "left")


def redact(rows: DataFrame, key: str, column: str, tokens: DataFrame) -> DataFrame:
    """The rows with the identifiers in ``column`` replaced; ``key`` is unique."""
    values = rows.select(key, F.explode(found_in(F.col(column))).alias("old"))
    values = values.join(tokens.select(F.col("value").alias("old"), F.col("token").alias("new")), "old").select(key, "old", "new", F.lit(False).alias("bare"))
    names = tokens.filter(~F.col("value").rlike(f"^(?:{_ANY})\\z")).select(F.col("value").alias("old"), F.col("token").alias("new"))
    held = candidates(rows, key, column, names).join(_by_shuffle(rows.select(key, F.col(column).alias("__text"))), key).filter(F.contains("__text", "old"))
    joined = _with_pairs(rows, key, values.union(held.select(key, "old", "new", F.lit(True).alias("bare"))))
    bare = F.transform(F.filter("__pairs", lambda p: p["bare"]), lambda p: F.replace(p["old"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")))
    pattern = F.when(F.size(bare) > 0, F.concat(F.lit(f"{_ANY}|(?<!{_OUTSIDE})(?:\\Q"), F.array_join(bare, "\\E|\\Q"), F.lit(f"\\E)(?!{_OUTSIDE})"))).otherwise(_ANY)
    return joined.withColumn(column, F.when(F.size("__pairs") > 0, _rewritten(F.col(column), pattern, F.col("__pairs"))).otherwise(F.col(column))).drop("__pairs")


_TOKEN = r"(?<![A-Za-z0-9])(?:PRINCIPAL|ROLE|BUCKET|FUNCTION|RESOURCE|TRAIL|KEY|ACCOUNT|IP-PRIVATE|IP)-\d+(?![A-Za-z0-9])"


def restore(rows: DataFrame, key: str, column: str, tokens: DataFrame) -> DataFrame:
    held = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(_TOKEN), F.lit(0)))).alias("old"))
    back = tokens.groupBy(F.col("token").alias("old")).agg(F.max("restored").alias("new"))
    joined = _with_pairs(rows, key, held.join(back, "old").select(key, "old", "new", F.lit(False).alias("bare")))
    return joined.withColumn(column, F.when(F.size("__pairs") > 0, _rewritten(F.col(column), F.lit(_TOKEN), F.col("__pairs"))).otherwise(F.col(column))).drop("__pairs")


# The members of JSON texts that hold a bare name.
NAME_FIELDS = (
    "userName", "UserName", "roleName", "RoleName", "principalName", "sessionName", "user_name", "role_name",
    "trailName", "TrailName", "name", "Name", "functionName", "FunctionName",
)


def harvested(texts: DataFrame, column: str) -> DataFrame:
    """(name, kind): the bare names of three characters or more in the name fields of JSON texts, at any depth; the kind follows from the field."""
    member = rf'"({"|".join(NAME_FIELDS)})"\s*:\s*"((?:[^"\\]|\\.)*)"'
    part = lambda i: F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(member), F.lit(i))
    each = texts.select(F.explode(F.arrays_zip(part(1).alias("field"), part(2).alias("name"))).alias("m")).select(F.lower("m.field").alias("field"), _unescaped(F.col("m.name")).alias("name"))
    field = F.col("field")
    kind = F.when(field.contains("role"), "ROLE").when(field.contains("trail"), "TRAIL").when(field.contains("function"), "FUNCTION").when(field == "name", "RESOURCE").otherwise("PRINCIPAL")
    return each.filter(F.length("name") >= 3).groupBy("name").agg(F.min(kind).alias("kind"))


def _unescaped(text: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v")


def plain_json(rows: DataFrame, column: str) -> DataFrame:
    """The rows with JSON texts written anew, without escapes or spaces that aren't needed; a text that is no JSON stays."""
    return rows.withColumn(column, F.coalesce(F.to_json(F.try_parse_json(column)), F.col(column)))


def redact_json(rows: DataFrame, key: str, column: str, tokens: DataFrame) -> DataFrame:
    """The same for JSON texts, keys and values at any depth.

    Texts are written anew first, so that no escape hides an identifier; a text that is no JSON is taken as it stands.  Names
    are looked for as JSON spells them.
    """
    spelt = F.expr("substring(to_json(named_struct('v', value)), 7, length(to_json(named_struct('v', value))) - 8)")
    return redact(plain_json(rows, column), key, column, tokens.union(tokens.withColumn("value", spelt)).dropDuplicates(["value"]))


def mapping_summary(tokens: DataFrame) -> DataFrame:
    return tokens.select("kind", "token").distinct().groupBy("kind").agg(F.count("*").alias("n"))
