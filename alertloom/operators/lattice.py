"""Candidate conditions over all anchor fields: supports of single values, host pairs and triples in one grouped pass, the lattice that
relates them, a small selection for each rule, the facts on each and the verdict of the gates.

Input are alerts (rule_id, event_id, ts, lvl, fields map<string, array<string>>, and flags failure, fim, check, process of each).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions import anchors, context
from alertloom.functions import scalars as fn
from alertloom.functions.cuts import checkpointed
from alertloom.operators import noise
from alertloom.operators.labels import MIN_VERDICTS, wilson_lower

#: A narrower scope stands for its host from this share on; also the overlap from which a scope adds nothing.
NARROW = 0.8
#: Scopes chosen for a rule; sizes are compared in steps of a twentieth.
MOST, STEPS = 5, 20
#: Share of a host's alerts from outside that makes them exposure, evidence of false positives that a risky scope needs, and the share of
#: duplicates from which alerts are better grouped.
EXPOSED, EVIDENCE, DUPLICATES = 0.5, 0.8, 0.9
# Tactics whose rules need evidence, words apart by single blanks.
SENSITIVE = ("credential access", "lateral movement", "command and control", "exfiltration", "impact", "defense evasion", "stealth", "defense impairment", "privilege escalation", "persistence")
CONDITION = "array<struct<path:string,value:string>>"


def anchored(a: DataFrame, profile: str) -> DataFrame:
    """``a`` with host (path, value) and vals, the array of its anchor values."""
    at = a.withColumn("host", anchors.host(F.col("fields"), profile))
    return at.withColumn("vals", anchors.values(F.col("fields"), F.col("host"), profile))


def _condition(*pairs: tuple[Column, Column]) -> Column:
    """Conditions in order of their paths, as one value to group by."""
    return F.array_sort(F.array(*[F.struct(p.alias("path"), v.alias("value")) for p, v in pairs]))


def items(d: DataFrame) -> DataFrame:
    """A row for each scope that an alert lies in: rule_id, ts, lvl, event_id, shape (single, pair, triple), conditions, other (path beside
    the host), host. A value with a companion is scoped with it; values of the attacker alone are none."""
    host = F.struct(F.col("host.path").alias("path"), F.col("host.value").alias("value"))
    row = lambda shape, conditions, other, at: F.struct(F.lit(shape).alias("shape"), conditions.alias("conditions"), other.alias("other"), at.alias("at"))
    none = F.lit(None).cast("string")
    nowhere = F.lit(None).cast("struct<path:string,value:string>")
    singles = F.transform(F.filter("vals", lambda v: v["role"] != "attacker"), lambda v: row("single", _condition((v["path"], v["value"])), none, nowhere))
    beside = F.when(F.col("host").isNotNull(), F.filter("vals", lambda v: v["path"] != F.col("host.path"))).otherwise(F.array().cast(f"array<{anchors.VALUE}>"))
    partner = F.create_map(*[F.lit(x) for kv in anchors.COMPANIONS.items() for x in kv])
    pinned = lambda v: F.get(anchors.usable(F.element_at("fields", F.element_at(partner, v["path"]))), F.lit(0))

    def scoped(v: Column) -> Column:
        own = (F.col("host.path"), F.col("host.value")), (v["path"], v["value"])
        triple = row("triple", _condition(*own, (F.element_at(partner, v["path"]), pinned(v))), v["path"], host)
        return F.when(pinned(v).isNotNull(), triple).otherwise(row("pair", _condition(*own), v["path"], host))

    every = F.explode(F.concat(singles, F.transform(beside, scoped)))
    return d.select("rule_id", "event_id", "ts", "lvl", every.alias("x")).select("rule_id", "event_id", "ts", "lvl", "x.*")


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table, for every task if it has ``most`` rows at most; a larger one is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def by_day(found: DataFrame) -> DataFrame:
    """Counts of ``items`` per scope and day: what the shuffle carries is one row for each, however many alerts there are."""
    scope = ("rule_id", "shape", "conditions", "other", "at")
    return found.groupBy(*scope, noise.day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lvl") >= noise.HIGH).alias("high"), F.min(F.unix_seconds("ts")).alias("first_s"))


def supports(days: DataFrame) -> DataFrame:
    """Per rule and conditions: n, high, first second, days with alerts, peak day and the days' counts, from ``by_day``."""
    return days.groupBy("rule_id", "shape", "conditions", "other", "at").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.min("first_s").alias("first_s"), F.count(F.lit(1)).alias("present"), F.max("n").alias("peak"), F.sort_array(F.collect_list("n")).alias("counts"),
    )


def rules(d: DataFrame) -> DataFrame:
    """Per rule: total, top level, whether any of its alerts is of a context, distinct sessions of its values."""
    print_ = F.array_join(F.transform("vals", lambda v: F.concat_ws("\x1f", v["path"], F.when(v["role"] == "attacker", fn.free_text(v["value"])).otherwise(v["value"]))), "\x1f")
    session = F.xxhash64(F.floor(F.unix_seconds("ts") / noise.CLUSTER_GAP_S), print_)
    flags = [F.bool_or(c).alias(c) for c in ("failure", "fim", "check", "process")]
    return d.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"), F.max("lvl").alias("top"), F.count_distinct(session).alias("sessions"), *flags)


def lattice(found: DataFrame, by_rule: DataFrame, profile: str, trusted: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The scopes worth a condition: rule_id, conditions, kinds (a class for each), n, high, first_s, present, peak, counts, container, host.

    ``found`` are ``supports``, ``by_rule`` are ``rules``. A scope must reach MIN_SHARE of its rule and MIN_EVENTS. A single value must
    identify a host; a pair needs a host that does, and nothing generic. Pairs of a field that comes with a companion in the rule fall;
    a log source or machine account beside its own host falls where it is as good as the host. A host falls where the scopes inside of it over one other field
    reach NARROW of it, or where one of them holds nothing that an attacker chooses.
    """
    roles = F.create_map(*[F.lit(x) for kv in {**anchors.FIELDS[profile], **{c: "context" for c in anchors.COMPANIONS.values()}}.items() for x in kv])
    kind = lambda c: anchors.classified(c["path"], F.element_at(roles, c["path"]), c["value"], F.col("failure"), F.col("fim"), trusted)
    d = found.join(by_rule, "rule_id").filter((F.col("n") >= noise.MIN_SHARE * F.col("total")) & (F.col("n") >= noise.MIN_EVENTS))
    d = checkpointed(d.withColumn("kinds", F.transform("conditions", kind)))
    singles = d.filter("shape = 'single'").withColumn("k", F.col("kinds")[0])
    hosts = singles.filter("k.host_like").select("rule_id", F.col("conditions")[0].alias("at"), F.col("n").alias("host_n"))
    first = lambda c: F.get(c, F.lit(0))
    both = F.arrays_zip("conditions", "kinds")
    own = first(F.filter("conditions", lambda c: c["path"] == F.col("other")))["value"]
    spot = first(F.filter(both, lambda z: z["conditions"]["path"] == F.col("at.path")))["kinds"]
    pairs = d.filter("shape <> 'single'").withColumn("k", first(F.filter(both, lambda z: z["conditions"]["path"] == F.col("other")))["kinds"])
    pinned = found.filter("shape = 'triple'").select("rule_id", F.col("at.path").alias("path"), "other").distinct()
    pairs = pairs.withColumn("path", F.col("at.path")).filter(spot["alone"] & ~F.exists("kinds", lambda k: k["never"]))
    pairs = pairs.filter("shape = 'triple'").unionByName(pairs.filter("shape = 'pair'").join(pinned, ["rule_id", "path", "other"], "left_anti"))
    machine = (F.element_at(roles, F.col("other")) == "user") & fn.is_machine_account(own) & (F.concat(F.substring_index(F.lower(F.trim(F.col("at.value"))), ".", 1), F.lit("$")) == fn.account_name(own))
    pairs = pairs.withColumn("machine", F.coalesce(machine, F.lit(False))).withColumn("weak", F.col("machine") | (F.element_at(roles, F.col("other")) == "source"))
    plain = F.struct(*[F.lit(False).alias(f) for f in ("alone", "attacker", "external", "internal", "trusted", "host_like", "never", "chosen")])
    pairs = pairs.withColumn("kinds", F.when(F.col("machine"), F.zip_with("conditions", "kinds", lambda c, k: F.when(c["path"] == F.col("other"), plain).otherwise(k))).otherwise(F.col("kinds")))
    pairs = pairs.join(hosts, ["rule_id", "at"], "left").filter(~F.col("weak") | F.col("host_n").isNull() | (F.col("n") < NARROW * F.col("host_n")))
    narrow = pairs.filter("not weak").groupBy("rule_id", "at", "other").agg(F.sum("n").alias("covered"), F.bool_or(~F.col("k.attacker")).alias("stable"))
    narrow = narrow.groupBy("rule_id", "at").agg(F.max("covered").alias("covered"), F.bool_or("stable").alias("stable"))
    alone = singles.filter("k.alone and not k.never").withColumn("at", F.col("conditions")[0]).join(narrow, ["rule_id", "at"], "left")
    falls = F.col("k.host_like") & (F.coalesce(F.col("covered") >= NARROW * F.col("n"), F.lit(False)) | F.coalesce("stable", F.lit(False)))
    alone = alone.filter(~falls).withColumn("host", F.when(F.col("k.host_like"), F.col("at"))).withColumn("container", F.when(F.col("k.host_like"), F.col("n")).otherwise(F.col("total")))
    pairs = pairs.withColumn("host", F.col("at")).withColumn("container", F.coalesce("host_n", F.lit(0)))
    cols = ["rule_id", "conditions", "kinds", "n", "high", "first_s", "present", "peak", "counts", "host", "container", *[c for c in by_rule.columns if c != "rule_id"]]
    return alone.select(cols).unionByName(pairs.select(cols)).withColumn("strength", strength(F.col("kinds"))).withColumn("subject", fn.subject(F.col("rule_id"), F.transform("conditions", lambda c: F.struct(c["path"].alias("field"), c["value"].alias("value")))))


def strength(kinds: Column) -> Column:
    """2 with a trusted anchor, 1 without, 0 where an attacker or the outside has a say."""
    return F.when(F.exists(kinds, lambda k: k["attacker"] | k["external"]), 0).when(F.exists(kinds, lambda k: k["trusted"]), 2).otherwise(1)


def selected(scopes: DataFrame) -> DataFrame:
    """Of each rule's scopes, MOST at most, in ``nth`` order: the largest (in steps), then the safest, then the narrowest, less those that
    add nothing to one before: nested ones, and those that must share NARROW of their alerts with it.

    A rule has few scopes, as each holds MIN_SHARE of it over one of the listed fields: they are folded in one array.
    """
    order = F.struct((-F.floor(STEPS * F.col("n") / F.col("total"))).alias("step"), (-F.col("strength")).alias("safe"), (-F.size("conditions")).alias("narrow"), (-F.col("n")).alias("size"), F.col("subject"), F.col("conditions"), F.col("host"), F.col("container"), F.col("n"))
    lists = scopes.groupBy("rule_id").agg(F.array_sort(F.collect_list(order)).alias("all"), F.any_value("total").alias("total"))
    nested = lambda x, y: (F.size(F.array_except(x["conditions"], y["conditions"])) == 0) | (F.size(F.array_except(y["conditions"], x["conditions"])) == 0)

    def shares(x: Column, y: Column) -> Column:
        one = F.coalesce(x["host"] == y["host"], F.lit(False)) & (F.least(x["container"], y["container"]) > 0)
        room = F.when(one, F.least(x["container"], y["container"])).otherwise(F.col("total"))
        return x["n"] + y["n"] - room >= NARROW * x["n"]

    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when((F.size(kept) >= MOST) | F.exists(kept, lambda y: nested(x, y) | shares(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    chosen = lists.select("rule_id", F.posexplode(fold).alias("pos", "x")).select("rule_id", F.col("x.subject").alias("subject"), (F.col("pos") + 1).alias("nth"))
    return scopes.join(chosen, ["rule_id", "subject"])


def linked_highs(d: DataFrame) -> DataFrame:
    """High alerts per entity and hour: kind, key, h, n; every value of an alert that links counts once."""
    each = d.filter(F.col("lvl") >= noise.HIGH).select("rule_id", "event_id", noise.hour(F.col("ts")).alias("h"), F.explode("vals").alias("v")).withColumn("kind", context.link_kind(F.col("v.role"), F.col("v.value"))).filter("kind is not null")
    once = each.select("rule_id", "event_id", "h", "kind", context.link_key(F.col("kind"), F.col("v.value")).alias("key")).distinct()
    return once.groupBy("kind", "key", "h").agg(F.count(F.lit(1)).alias("n"))


def facts(scopes: DataFrame, found: DataFrame, counts: DataFrame, d: DataFrame, profile: str, verdicts: DataFrame | None = None) -> DataFrame:
    """``scopes`` with what the gates ask: n_days, novel, persistence, burst, co_hits, beacon, tp, fp, btp, rule_tp, exposed.

    ``counts`` are ``by_day``, ``found`` the ``items``, ``d`` the anchored alerts, all written tables like ``scopes``, ``verdicts`` (event_id, verdict) of alerts.
    """
    roles = F.create_map(*[F.lit(x) for kv in anchors.FIELDS[profile].items() for x in kv])
    w = d.agg(F.min(F.unix_seconds("ts")).alias("s0"), F.max(F.unix_seconds("ts")).alias("s1"), F.min(noise.day(F.col("ts"))).alias("d0"), F.max(noise.day(F.col("ts"))).alias("d1")).withColumn("n_days", F.col("d1") - F.col("d0") + 1)
    s = scopes.join(F.broadcast(w))
    s = s.withColumn("novel", F.col("first_s") > F.col("s0") + noise.NOVELTY * (F.col("s1") - F.col("s0"))).withColumn("persistence", F.col("present") / F.col("n_days"))
    # the median day from the counts and the days without alerts
    size = F.col("n_days")
    at = lambda i: F.when(i < size - F.col("present"), F.lit(0)).otherwise(F.get("counts", (i - (size - F.col("present"))).cast("int")))
    half = F.floor((size - 1) / 2)
    median = (at(half) + at(F.floor(size / 2))) / 2
    s = s.withColumn("burst", F.col("peak") >= noise.BURST * F.greatest(median, F.lit(1.0)))
    # days on which each scope has alerts, and those within reach of high alerts of its values
    pick = few(scopes.select("rule_id", "subject", "conditions"))
    days = counts.join(pick, ["rule_id", "conditions"]).select("rule_id", "subject", "day").distinct()
    link = lambda c: context.link_kind(F.element_at(roles, c["path"]), c["value"])
    entity = pick.select("rule_id", "subject", F.explode("conditions").alias("c")).withColumn("kind", link(F.col("c"))).filter("kind is not null").withColumn("key", context.link_key(F.col("kind"), F.col("c.value")))
    highs = linked_highs(d)
    near = lambda edge: F.floor((F.col("h") * 3600 + edge) / 86400)
    span = F.sequence(near(-noise.CO_WINDOW_H * 3600), near(3599 + noise.CO_WINDOW_H * 3600))
    reach = highs.join(entity.select("rule_id", "subject", "kind", "key"), ["kind", "key"]).withColumn("day", F.explode(span))
    hits = reach.join(days, ["rule_id", "subject", "day"]).select("rule_id", "subject", "kind", "key", "h", "n").distinct().groupBy("rule_id", "subject").agg(F.sum("n").alias("co_hits"))
    s = s.join(hits, ["rule_id", "subject"], "left")
    # addresses from outside that beat steadily inside of a scope
    public = F.filter("conditions", lambda c: F.element_at(roles, c["path"]).isin("src_ip", "peer_ip") & (anchors.addresses.kind(c["value"]) == "external"))
    wide = found.filter("shape <> 'triple'").withColumn("public", public).filter(F.size("public") > 0)
    beat = noise.beacons(wide, ("rule_id", "conditions")).filter("beacon_like").select("rule_id", F.col("conditions").alias("beat"))
    inside = pick.withColumn("c", F.explode("conditions")).join(beat.withColumn("c", F.explode("beat")), ["rule_id", "c"])
    inside = inside.select("rule_id", "subject", F.lit(True).alias("beacon")).distinct()
    s = s.join(inside, ["rule_id", "subject"], "left")
    # a whole host whose alerts come from outside
    outside = F.exists("vals", lambda v: v["path"].isin(*anchors.SOURCES) & (anchors.addresses.kind(v["value"]) == "external"))
    by_host = d.filter(outside & F.col("host").isNotNull()).groupBy("rule_id", F.struct(F.col("host.path").alias("path"), F.col("host.value").alias("value")).alias("host")).agg(F.count(F.lit(1)).alias("outside"))
    s = s.join(by_host, ["rule_id", "host"], "left").withColumn("exposed", F.coalesce((F.size("conditions") == 1) & (F.col("outside") >= EXPOSED * F.col("n")), F.lit(False)))
    if verdicts is not None:
        said = found.join(verdicts, "event_id").join(pick, ["rule_id", "conditions"]).groupBy("rule_id", "subject").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("tp", "fp", "btp")])
        s = s.join(said, ["rule_id", "subject"], "left")
    else:
        s = s.withColumns({v: F.lit(0) for v in ("tp", "fp", "btp")})
    return s.na.fill(0, ["tp", "fp", "btp", "co_hits"]).withColumn("beacon", F.coalesce("beacon", F.lit(False)))


def gated(s: DataFrame, max_level: int = 11, min_days: int = 7) -> DataFrame:
    """``s`` (facts, with tactics array and rule_tp) with failed, the gates that fail in order, and verdict.

    Learning comes first; then level and true positives forbid; novelty, persistence, burst, high alerts nearby and beacons ask for an
    investigation; file and policy checks and exposure are fixed at their source; a sensitive rule needs a trusted inner anchor and
    evidence (or grouping, if it repeats), a chosen name needs evidence; what is left may be tuned.
    """
    triaged = F.col("tp") + F.col("fp") + F.col("btp")
    lower = F.when(triaged >= MIN_VERDICTS, wilson_lower((F.col("fp") + F.col("btp")).cast("double"), triaged.cast("double")))
    proven = F.coalesce(lower >= EVIDENCE, F.lit(False)) & (F.col("tp") == 0)
    sensitive = F.exists("tactics", lambda t: F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), "[-_]", " "), r"\s+", " ").isin(*SENSITIVE)) | F.col("process")
    has = lambda f: F.exists("kinds", f)
    inner = ~has(lambda k: k["attacker"] | k["external"]) & has(lambda k: k["trusted"])
    gates = {
        "level": F.col("top").isNull() | (F.col("top") > max_level), "tp_rule_wide": F.col("rule_tp") > 0, "tp": F.col("tp") > 0, "novelty": F.col("novel"),
        "persistence": F.col("persistence") < noise.PERSISTENCE, "burst": F.col("burst"), "co_occurrence": F.col("co_hits") > 0, "beacon": F.col("beacon"),
        "sensitive": sensitive & ~(inner & proven), "attacker_field": has(lambda k: (k["attacker"] | k["chosen"]) & ~k["external"]) & ~proven,
        "external": has(lambda k: k["external"]) | F.col("exposed"), "fim": F.col("fim"), "check": F.col("check"),
    }
    failed = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), k) for k, v in gates.items()]))
    s = s.withColumn("failed", F.when(F.col("n_days") < min_days, F.array(F.lit("learning"))).otherwise(failed))
    any_of = lambda *names: F.arrays_overlap("failed", F.array(*map(F.lit, names)))
    repeats = 1 - F.col("sessions") / F.col("total") >= DUPLICATES
    verdict = F.when(any_of("learning"), "learning").when(any_of("level", "tp", "tp_rule_wide"), "do_not_tune").when(any_of("novelty", "persistence", "burst", "co_occurrence", "beacon"), "investigate")
    verdict = verdict.when(any_of("fim", "check", "external"), "fix_at_source").when(any_of("sensitive"), F.when(repeats, "aggregate").otherwise("investigate")).when(any_of("attacker_field"), "investigate").otherwise("tune")
    return s.withColumn("verdict", verdict)


def candidates(a: DataFrame, profile: str, trusted: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scopes of the lattice, items, their counts by day, anchored alerts) of ``a``; the latter three are written tables."""
    d = checkpointed(anchored(a, profile))
    found = checkpointed(items(d))
    counts = checkpointed(by_day(found))
    return lattice(supports(counts), rules(d), profile, trusted), found, counts, d


def judged(a: DataFrame, profile: str, tactics: DataFrame, verdicts: DataFrame, rule_verdicts: DataFrame, trusted: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The chosen scopes of ``a`` with facts and verdicts. ``tactics`` is (rule_id, tactics), ``verdicts`` (event_id, verdict) of single
    alerts, ``rule_verdicts`` (rule_id, verdict) of whole rules."""
    scopes, found, counts, d = candidates(a, profile, trusted)
    chosen = checkpointed(selected(scopes))
    wide = rule_verdicts.filter("verdict = 'tp'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("rule_tp"))
    s = facts(chosen, found, counts, d, profile, verdicts).join(tactics, "rule_id", "left").join(wide, "rule_id", "left").na.fill(0, ["rule_tp"])
    return gated(s.withColumn("tactics", F.coalesce("tactics", F.array().cast("array<string>"))))
