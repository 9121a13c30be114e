"""The five reduction tiers over canonical events, and their counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions.shared import stored
from emberlog.schema import actor_of, truncated


def allowlist(groups: Sequence[str] = rules.DEFAULT_GROUPS, extra: dict[str, tuple[str, ...]] | None = None, strict: bool = False) -> tuple[str, ...]:
    """Event names of the groups; unknown groups have none.

    Unless ``strict``, the names come along that correlation needs and no group has.
    """
    known = {**rules.EVENT_GROUPS, **(extra or {})}
    names = [n for g in groups for n in known.get(g, ())]
    return tuple(dict.fromkeys(names if strict else [*names, *rules.LOGGING_RESTORE, *rules.CORRELATED_ONLY]))


def is_in_window(start: str, end: str) -> Column:
    return F.col("event_ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def in_window(events: DataFrame, start: str, end: str) -> DataFrame:
    """Tier 1: both ends belong to the window."""
    return events.filter(is_in_window(start, end))


def has_name(names: Sequence[str]) -> Column:
    return F.col("event_name").isin(*names)


def with_names(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """Tier 2."""
    return events.filter(has_name(names))


def has_actor(parts: Sequence[str]) -> Column:
    if not parts:
        return F.lit(True)
    actor, hit = actor_of(), F.lit(False)
    for p in parts:
        hit = hit | actor.contains(p)
    return (actor != "") & hit


def with_actors(events: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Tier 3: actors that contain any of the parts; case counts, and no parts keep all."""
    return events.filter(has_actor(parts))


def collapse_runs(events: DataFrame) -> DataFrame:
    """Tier 4: of more than two events alike, the first, with count and window, and the last.

    Alike: same name, actor, address, account and region, over the whole input.  A hash of these is counted first, in fixed-size buffers; events of
    hashes with one or two rows are no run and pass as they are.  Only the others are grouped: of each group, tasks send on a count and its two ends.
    """
    alike = [F.coalesce(c, F.lit("")) for c in (F.col("event_name"), actor_of(), F.col("source_ip"), F.col("account"), F.col("region"))]
    keyed = events.withColumn("__alike", F.xxhash64(*alike))
    often = keyed.groupBy("__alike").agg(F.count("*").alias("n")).filter("n > 2").select("__alike", F.lit(True).alias("__often"))
    keyed = keyed.join(often, "__alike", "left")
    row = F.struct(F.coalesce("event_time", F.lit("")).alias("at"), F.col("row_id").alias("id"), F.struct(*events.columns).alias("row"))
    keys = [c.alias(f"__k{i}") for i, c in enumerate(alike)]
    runs = keyed.filter("__often").groupBy("__alike", *keys).agg(F.count("*").alias("n"), F.min(row).alias("first"), F.max(row).alias("last"))
    window = F.when(F.col("n") > 2, F.array("first.at", "last.at"))
    first = F.col("first.row").withField("repeat_count", F.coalesce(F.when(F.col("n") > 2, F.col("n")), F.col("first.row.repeat_count"))).withField("repeat_window", F.coalesce(window, F.col("first.row.repeat_window")))
    ends = runs.select(F.inline(F.when(F.col("n") > 1, F.array(first, F.col("last.row"))).otherwise(F.array(first)))).select(*events.columns)
    return keyed.filter("__often IS NULL").select(*events.columns).union(ends)


def signal_rank(name: Column) -> Column:
    """0 for critical events, then identity changes, data access, persistence, all others."""
    g = rules.EVENT_GROUPS
    return F.when(name.isin(*rules.CRITICAL_EVENTS), 0).when(name.isin(*g["identity_mutation"]), 1).when(name.isin(*g["data_access"]), 2).when(name.isin(*g["persistence"]), 3).otherwise(4)


# Limits of request parameters in characters, of members, and of a member's text.
PARAMS_LIMIT, MEMBERS, MEMBER_LIMIT = 260, 8, 60

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)'  #: a JSON string, the last one perhaps cut off


def _outside_strings(text: Column, change: Callable[[Column], Column], string: Callable[[Column], Column] = lambda s: s) -> Column:
    """A JSON text with what lies between strings, and the strings themselves, changed."""
    gaps, strings = F.split(text, _STRING, -1), F.regexp_extract_all(text, F.lit(_STRING), F.lit(0))
    return F.array_join(F.zip_with(gaps, strings, lambda g, s: F.concat(change(g), F.coalesce(string(s), F.lit("")))), "")


def _spaced(gap: Column) -> Column:
    return F.regexp_replace(gap, "([,:])", "$1 ")


def dumps_length(text: Column) -> Column:
    """How many characters a compact JSON text has when written with a space after commas and colons, and with escapes for all but ASCII."""
    gaps = F.regexp_replace(text, _STRING, "")
    spaces = 2 * F.length(gaps) - F.length(F.replace(gaps, F.lit(","))) - F.length(F.replace(gaps, F.lit(":")))
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    paired = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]+", ""))
    return F.length(text) + spaces + F.when(_is_ascii(text), 0).otherwise(5 * wide + 6 * paired)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _dumps_start(text: Column, limit: int) -> Column:
    """The first characters of a compact JSON text, written with spaces and escapes."""
    escape = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def ascii_only(c: Column) -> Column:
        n = F.ascii(c).cast("bigint")
        pair = F.concat(escape(F.shiftright(n - 0x10000, 10) + 0xD800), escape((n - 0x10000) % 1024 + 0xDC00))
        return F.when(n < 128, c).when(n < 0x10000, escape(n)).otherwise(pair)

    escaped = lambda start: F.when(_is_ascii(start), start).otherwise(F.array_join(F.transform(F.split(start, ""), ascii_only), ""))
    return F.substring(_once(_outside_strings(F.substring(text, 1, limit), _spaced), escaped), 1, limit)


def _quoted(string: Column) -> Column:
    """A JSON string as Python shows it inside lists and objects."""
    value = F.get_json_object(F.concat(F.lit('{"v":'), string, F.lit("}")), "$.v")
    for old, new in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(old), F.lit(new))
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _constants(gap: Column) -> Column:
    return F.replace(F.replace(F.replace(gap, F.lit("true"), F.lit("True")), F.lit("false"), F.lit("False")), F.lit("null"), F.lit("None"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _members(text: Column, kind: str) -> Column:
    """The members of a JSON object as a map; of repeated ones the last counts."""
    last = lambda every: F.filter(every, lambda m, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda later: later["key"] == m["key"]))
    told_apart = lambda m: F.when(F.size(F.array_distinct(F.map_keys(m))) == F.size(m), m).otherwise(F.map_from_entries(last(F.map_entries(m))))
    return _once(F.from_json(text, f"map<string,{kind}>"), told_apart)


def _members_in_short(text: Column) -> Column:
    """Of a JSON object the first members in its own order, each a text of bounded length: strings as they are, all else as Python shows it."""

    def short(name: Column, kind: Column, value: Column) -> Column:
        nested = _outside_strings(value, lambda g: _constants(_spaced(g)), _quoted)
        shown = F.when(kind == "STRING", value).when(kind.rlike("^(OBJECT|ARRAY)"), nested).otherwise(_constants(F.coalesce(value, F.lit("null"))))
        return F.struct(name.alias("name"), truncated(shown, MEMBER_LIMIT).alias("value"))

    names = F.slice(F.array_distinct(F.json_object_keys(text)), 1, MEMBERS)
    both = F.struct(names.alias("names"), _members(text, "variant").alias("kinds"), _members(text, "string").alias("texts"))
    each = _once(both, lambda b: F.transform(b["names"], lambda n: short(n, F.schema_of_variant(F.element_at(b["kinds"], n)), F.element_at(b["texts"], n))))
    return F.to_json(F.map_from_entries(each))


def pruned_params(params: Column) -> Column:
    """Request parameters as compact JSON: whole up to a limit; of longer objects the first members in short; of anything else longer its first characters.

    What is no JSON counts as a text, and so does an object that has members repeated below its own.  Numbers are written as the JSON functions write them.
    """
    given = F.nullif(params, F.lit(""))
    parsed = F.to_json(F.try_parse_json(given))
    repeated = F.when(given.rlike(r"(?s)^\s*\{.*\}\s*$"), F.to_json(_members(given, "variant")))

    def pruned(plain: Column) -> Column:
        text = F.coalesce(plain, _json(given))
        # no text is shorter than its characters, and long ones aren't looked through
        return F.when((F.length(text) <= PARAMS_LIMIT) & (dumps_length(text) <= PARAMS_LIMIT), text).when(plain.startswith("{"), _members_in_short(given)).otherwise(_json(_dumps_start(text, PARAMS_LIMIT)))

    return F.when(given.isNotNull(), _once(F.coalesce(parsed, repeated), pruned))


def _json(c: Column) -> Column:
    """A value as JSON; null for null."""
    one = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substr(one, F.lit(6), F.length(one) - 6))


def slim_json() -> Column:
    """The slim record of a canonical event as compact JSON: members without a value are left out, those of the actor are null."""
    col = F.col
    or_null = lambda c: F.coalesce(_json(c), F.lit("null"))
    actor = F.concat(F.lit('{"type":'), or_null(col("actor.type")), F.lit(',"arn":'), or_null(col("actor.arn")), F.lit(',"userName":'), or_null(col("actor.user_name")), F.lit("}"))
    minted = F.concat(F.lit('{"credentials":{"accessKeyId":'), _json(F.nullif("minted_key_id", F.lit(""))), F.lit("}}"))
    members = [
        ("eventTime", _json(col("event_time"))), ("eventName", _json(col("event_name"))), ("eventSource", _json(col("event_source"))), ("awsRegion", _json(col("region"))),
        ("sourceIPAddress", _json(col("source_ip"))), ("userAgent", _json(truncated(col("user_agent"), 80))), ("account", _json(col("account"))), ("actor", actor),
        ("accessKeyId", _json(col("access_key_id"))), ("responseElements", minted), ("errorCode", _json(col("error_code"))), ("requestParameters", pruned_params(col("request_params"))),
        ("repeatCount", _json(col("repeat_count"))), ("repeatWindow", _json(col("repeat_window"))), ("mfaAuthenticated", _json(col("mfa_authenticated"))),
    ]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f'"{n}":'), v) for n, v in members])), ","), F.lit("}"))


def slim(events: DataFrame) -> DataFrame:
    """(row_id, event_time, slim, cost): the slim records and how many characters they have."""
    return events.select("row_id", "event_time", F.explode(F.array(slim_json())).alias("slim")).withColumn("cost", dumps_length(F.col("slim")))


#: Rows of each budget that one round of filling looks at.
CHUNK = 4096


def _literal(df: DataFrame, names: Sequence[str], values: Sequence[object]) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[n].dataType).alias(n) for n, v in zip(names, values, strict=True)])


def fill_steps(priced: DataFrame, names: Sequence[str], capacity: int, chunk: int = CHUNK) -> tuple[list[tuple[tuple, int]], int]:
    """Where the most that a row may cost falls, and to what: [(rank, most)]; and the least cost of all.

    priced: (``names`` of the rank, ``__cost``).  The driver sees counts and sums by cost class, then in rounds the next rows that may still fit, no more of them than
    ``left // least + 1``, as one of so many doesn't fit.  What is left then is less than that row's cost, so rounds are few.
    """
    kind = (F.length(F.bin("__cost")) - 1).alias("kind")
    found = priced.filter(F.col("__cost").between(1, capacity)).groupBy(kind).agg(F.count("*").alias("n"), F.sum("__cost").alias("total"), F.min("__cost").alias("least")).collect()
    classes = {r.kind: [r.total, r.least] for r in found}
    left, most, after, steps = capacity, capacity, None, []
    while True:
        open_ = [c for c in classes.values() if c[0] > 0 and c[1] <= most]
        if sum(c[0] for c in open_) <= left:
            break
        rows = priced.filter(F.col("__cost").between(1, most))
        if after is not None:
            rows = rows.filter(F.struct(*names) > _literal(priced, names, after))
        seen = rows.orderBy(*names).limit(min(chunk, left // min(c[1] for c in open_) + 1)).collect()
        if not seen:
            break
        for r in seen:
            cost, after = r["__cost"], tuple(r[n] for n in names)
            classes[cost.bit_length() - 1][0] -= cost
            if cost <= left:
                left -= cost
            elif cost <= most:
                steps, most = [*steps, (after, left)], left
    return steps, min((r.least for r in found), default=1)


def _steps_by_key(priced: DataFrame, names: Sequence[str], capacity: int, keys: Sequence[str], chunk: int) -> DataFrame:
    """The same for budgets by key, all in the same rounds: (keys, steps, least)."""
    none = F.lit(None)
    rank = "struct<" + ",".join(f"{n}:{priced.schema[n].dataType.simpleString()}" for n in names) + ">"
    budgets = priced.groupBy(*keys).agg(F.min("__cost").alias("least"))
    state = budgets.select(*keys, "least", F.lit(capacity).cast("bigint").alias("left"), F.lit(capacity).cast("bigint").alias("most"), none.cast(rank).alias("after"), F.array().cast(f"array<struct<at:{rank},most:bigint>>").alias("steps"), F.lit(True).alias("open"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*names))
    while True:
        rows = priced.join(state.filter("open").select(*keys, "most", "after"), [*keys]).filter((F.col("__cost") <= F.col("most")) & (F.col("after").isNull() | (F.struct(*names) > F.col("after"))))
        seen = rows.select(*keys, *names, "__cost").withColumn("__nth", nth).filter(F.col("__nth") <= chunk)  # tasks send on so many of each budget
        seen = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.struct(*names).alias("at"), "__cost"))).alias("seen"))
        state = state.join(seen, [*keys], "left")
        start = F.struct("left", "most", "steps")

        def next_(a: Column, x: Column) -> Column:
            cost = x["__cost"]
            step = F.concat(a["steps"], F.array(F.struct(x["at"].alias("at"), a["left"].alias("most"))))
            return F.when(cost <= a["left"], F.struct((a["left"] - cost).alias("left"), a["most"].alias("most"), a["steps"].alias("steps"))).when(
                cost <= a["most"], F.struct(a["left"].alias("left"), a["left"].alias("most"), step.alias("steps"))
            ).otherwise(a)

        state = state.withColumn("now", F.when(F.size("seen") > 0, F.aggregate("seen", start, next_)).otherwise(start))
        full = F.coalesce(F.size("seen") == chunk, F.lit(False))
        state = stored(
            state.select(*keys, "least", "now.left", "now.most", F.when(full, F.element_at("seen", -1)["at"]).otherwise(F.col("after")).alias("after"), "now.steps", (full & (F.col("now.most") >= F.col("least"))).alias("open")), "budget"
        )
        if state.filter("open").isEmpty():
            return state.select(*keys, "steps", "least")


def greedy_fill(rows: DataFrame, rank: Sequence[Column], cost: Column, capacity: int, keys: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Takes rows in the order of ``rank`` as far as they fit, passing over those that don't.

    What is left only falls, so a row is taken if its cost is no more than what was left when the last row of a lower cost limit was passed over: the rows taken are those
    under a falling staircase of cost over rank.  Its steps are found in rounds over (rank, cost) alone; then one filter takes the rows, and nothing is sorted or joined as a whole.
    Costs below 1 are never taken.  ``keys``: columns, not null, that fill budgets of their own; their stairs are joined by key.  The rank tells all rows apart.
    """
    names = [f"__r{i}" for i in range(len(rank))]
    priced = stored(rows.select(*keys, *[r.alias(n) for r, n in zip(rank, names, strict=True)], cost.cast("bigint").alias("__cost")).filter(F.col("__cost").between(1, capacity)), "priced")
    here = F.struct(*[r.alias(n) for r, n in zip(rank, names, strict=True)])
    if keys:
        stairs = _steps_by_key(priced, names, capacity, keys, chunk).withColumnsRenamed({"steps": "__steps", "least": "__least"})
        passed = F.filter("__steps", lambda s: s["at"] <= here)
        limit = F.coalesce(F.try_element_at(passed, F.lit(-1))["most"], F.lit(capacity))
        return rows.join(stairs, [*keys]).filter((limit >= F.col("__least")) & cost.between(1, limit)).select(*rows.columns)
    steps, least = fill_steps(priced, names, capacity, chunk)
    limit, last = None, capacity
    for at, most in steps:
        below = here < _literal(priced, names, at)
        limit, last = F.when(below, last) if limit is None else limit.when(below, last), most
    limit = F.lit(last) if limit is None else limit.otherwise(last)
    return rows.filter((limit >= least) & cost.between(1, limit))


#: Characters of a slim record without any value.
_LEAST_RECORD = len('{"actor": {"type": null, "arn": null, "userName": null}}')


def least_cost() -> Column:
    """No more than the cost of an event's slim record, out of the lengths of its texts alone."""
    col = F.col
    texts = {
        "eventTime": col("event_time"), "eventName": col("event_name"), "eventSource": col("event_source"), "awsRegion": col("region"), "sourceIPAddress": col("source_ip"), "userAgent": truncated(col("user_agent"), 80),
        "account": col("account"), "accessKeyId": col("access_key_id"), "errorCode": col("error_code"), "mfaAuthenticated": col("mfa_authenticated"),
    }
    cost = F.lit(_LEAST_RECORD)
    for name, text in texts.items():
        cost = cost + F.coalesce(F.length(text) + len(f'"{name}": "", '), F.lit(0))
    for text in (col("actor.type"), col("actor.arn"), col("actor.user_name")):
        cost = cost + F.coalesce(F.length(text) + len('""') - len("null"), F.lit(0))
    return cost


def _priced(events: DataFrame) -> DataFrame:
    """Adds ``__chars``, the cost of each event's slim record."""
    # exploded from an array of one, as the optimizer would copy the long expression into each of its uses otherwise
    priced = events.select("*", F.explode(F.array(slim_json())).alias("__slim"))
    return priced.select(*events.columns, F.explode(F.array(dumps_length(F.col("__slim")))).alias("__chars"))


def fit_budget(events: DataFrame, tokens: int = 40_000) -> DataFrame:
    """Tier 5: events by signal, then time, as far as their slim records fit the budget; the rows come in time order.

    Records are only written of events that may fit: of the first ones, more than the budget can hold, and of those after them whose least cost is no more
    than what these leave.
    """
    capacity = int(tokens * rules.CHARS_PER_TOKEN)
    rank = [signal_rank(F.col("event_name")), F.coalesce("event_time", F.lit("")), F.col("row_id")]
    names = [f"__r{i}" for i in range(len(rank))]
    here = F.struct(*[r.alias(n) for r, n in zip(rank, names, strict=True)])
    ranks = events.select(*[r.alias(n) for r, n in zip(rank, names, strict=True)])
    first = ranks.orderBy(*names).limit(max(capacity, 0) // _LEAST_RECORD + 1).agg(F.max(F.struct(*names)).alias("at")).first()["at"]
    if first is None:
        return events.limit(0)
    last = _literal(ranks, names, tuple(first))
    head = stored(_priced(events.filter(here <= last)), "first")
    taken = greedy_fill(head, rank, F.col("__chars"), capacity)
    left = capacity - (taken.agg(F.sum("__chars").alias("n")).first()["n"] or 0)
    taken = taken.select(*events.columns)
    if left >= _LEAST_RECORD:
        others = _priced(events.filter((here > last) & (least_cost() <= left)))
        taken = taken.union(greedy_fill(others, rank, F.col("__chars"), left).select(*events.columns))
    return taken.orderBy(F.coalesce("event_time", F.lit("")), "row_id")


def reduce_events(events: DataFrame, start: str, end: str, names: Sequence[str] | None = None, actors: Sequence[str] = (), tokens: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """All five tiers: the selected events, and a row of counts."""
    steps = {"in_window": is_in_window(start, end), "allowed": has_name(names if names is not None else allowlist()), "scoped": has_actor(actors)}
    selected = fit_budget(collapse_runs(events.filter(steps["in_window"] & steps["allowed"] & steps["scoped"])), tokens)
    return selected, tier_counts(events, steps, {"selected": selected})


def tier_counts(raw: DataFrame, steps: dict[str, Column], later: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row: the count of each tier, that of ``collapsed`` runs, and the share of the first that the last leaves out.

    steps: conditions that narrow ``raw`` one after the other; later: tiers beyond the runs.  One pass over ``raw`` counts all but these: rows that
    pass every step are counted by what makes them alike, of which at most two stay; all others by how far they come.
    """
    depth, passed = F.lit(0), F.lit(True)
    for condition in steps.values():
        passed = passed & F.coalesce(condition, F.lit(False))
        depth = depth + passed.cast("int")
    alike = [F.when(passed, F.coalesce(c, F.lit(""))).alias(f"k{i}") for i, c in enumerate((F.col("event_name"), actor_of(), F.col("source_ip"), F.col("account"), F.col("region")))]
    cells = raw.groupBy(depth.alias("depth"), *alike).agg(F.count("*").alias("n"))
    reached = lambda d: F.coalesce(F.sum(F.when(F.col("depth") >= d, F.col("n"))), F.lit(0))
    counts = [reached(0).alias("raw"), *[reached(i).alias(name) for i, name in enumerate(steps, 1)]]
    kept = F.coalesce(F.sum(F.when(F.col("depth") == len(steps), F.least("n", F.lit(2)))), F.lit(0)).alias("collapsed")
    out = cells.agg(*counts, kept)
    for name, df in (later or {}).items():
        out = out.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    last = [*(later or {})][-1] if later else "collapsed"
    return out.withColumn("reduction_ratio", F.when(F.col("raw") > 0, F.round(1 - F.col(last) / F.col("raw"), 4)).otherwise(F.lit(0.0)))
