"""State transitions as pure functions: a state relation and a pinned time give the next state.

Persistence is a separate sink, so a transition can run as a batch, as a micro-batch, or be previewed.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import scores as S
from engramlake.functions import text as X

KEPT_KINDS = ["decision", "lesson"]
HALFLIFE = {"fact": 30.0, "preference": 30.0, "error": 14.0, "solution": 14.0}
BASE_HALFLIFE = 7.0
CHANGES_KEPT = 20


def days_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 86_400_000_000.0


def halflife(kind: Column) -> Column:
    out = F.lit(BASE_HALFLIFE)
    for k, v in HALFLIFE.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def decay(state: DataFrame, now: Column, protect: DataFrame | None = None) -> DataFrame:
    """Importance after stratified decay; decisions and lessons keep theirs, and so do rows used within a day and
    entities in ``protect``."""
    idle = days_between(F.col("last_accessed"), now)
    lost = S.decay(F.col("importance"), idle, halflife(F.col("kind")), F.col("access_count"))
    spared = F.col("kind").isin(KEPT_KINDS) | (idle <= 1)
    if protect is not None:
        state = state.join(protect.select("entity").distinct().withColumn("__safe", F.lit(True)), "entity", "left")
        spared = spared | F.col("__safe").isNotNull()
    out = state.withColumn("importance", F.when(spared, F.col("importance")).otherwise(lost))
    return out.drop("__safe")


def episode_decay(state: DataFrame, now: Column, c: float = 0.1, beta: float = 0.5) -> DataFrame:
    """0.5 / (1 + c * days)^beta with floor 0.01 for rows older than an hour; depends on the age only."""
    age = days_between(F.col("created_at"), now)
    return state.withColumn("importance", F.when(age > 1 / 24, F.greatest(F.lit(0.01), 0.5 / F.pow(1 + c * age, F.lit(beta)))).otherwise(F.col("importance")))


def prune(state: DataFrame, threshold: float) -> DataFrame:
    """Rows that stay."""
    return state.where((F.col("importance") >= threshold) | F.col("kind").isin(KEPT_KINDS))


def merge_duplicates(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (keep, drop): losers are superseded, keepers gain 0.05 a loser, at most 1."""
    gone = pairs.select(F.col("drop").alias("id")).distinct().withColumn("__gone", F.lit(True))
    gain = pairs.groupBy(F.col("keep").alias("id")).agg((F.count(F.lit(1)) * 0.05).alias("__gain"))
    out = state.join(gone, "id", "left").join(gain, "id", "left")
    out = out.withColumn("kind", F.when(F.col("__gone"), "superseded").otherwise(F.col("kind")))
    out = out.withColumn("importance", F.when(F.col("__gone"), F.col("importance")).otherwise(F.least(F.lit(1.0), F.col("importance") + F.coalesce("__gain", F.lit(0.0)))))
    return out.drop("__gone", "__gain")


def retire_overload(state: DataFrame, most: int = 50, floor: float = 0.05) -> DataFrame:
    """Weak notes of entities with more than ``most`` notes are superseded."""
    n = state.groupBy("entity").agg(F.count(F.lit(1)).alias("__n"))
    out = state.join(n, "entity")
    return out.withColumn("kind", F.when((F.col("__n") > most) & (F.col("importance") < floor), "superseded").otherwise(F.col("kind"))).drop("__n")


def access_boost(state: DataFrame, elapsed: Column, theta: Column) -> DataFrame:
    """One access: the step shrinks as the count nears the sliding threshold, and with the time since the last."""
    throttle = F.greatest(F.lit(0.1), 1 - F.col("access_count") / F.greatest(theta, F.col("access_count")) * S.THROTTLE)
    step = S.ACCESS_BOOST * throttle * (1 - F.exp(-F.least(elapsed, F.lit(86400.0)) / 600.0))
    return state.select("*", F.least(F.lit(1.0), F.col("importance") + step).alias("boosted"),
                        F.greatest(F.lit(10.0), 0.85 * theta + 0.15 * F.col("access_count")).alias("theta"), (F.col("access_count") + 1).alias("accesses"))


def neighbour_boost(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Neighbours of ``node`` gain half the access boost times their strongest edge."""
    from engramlake.operators.relational import endpoints

    near = endpoints(edges).where(F.col("node") == node).groupBy(F.col("other").alias("id")).agg(F.max("strength").alias("__s"))
    out = nodes.join(near, "id", "left")
    return out.withColumn("importance", F.least(F.lit(1.0), F.col("importance") + 0.5 * S.ACCESS_BOOST * F.coalesce("__s", F.lit(0.0)))).drop("__s")


def feedback(positive: Column, importance: Column = None, access: Column = None) -> Column:
    """Importance after a judgement; the step shrinks with the access count."""
    i, a = F.col("importance") if importance is None else importance, F.col("access_count") if access is None else access
    step = 0.05 / F.sqrt(1 + a / 100.0)
    return F.when(positive, F.least(F.lit(1.0), i + step * (1 - i))).otherwise(F.greatest(F.lit(0.01), i - step * i))


def correct(state: DataFrame, changes: DataFrame, content: str = "content") -> DataFrame:
    """``changes`` (id, put): the old text joins the history (newest kept), the version grows, the vector is void."""
    out = state.join(changes.select("id", "put"), "id", "left")
    hit = F.col("put").isNotNull()
    history = F.coalesce(F.col("history"), F.array().cast("array<string>"))
    longer = F.array_append(history, F.col(content))
    newest = F.when(F.size(longer) > CHANGES_KEPT, F.slice(longer, -CHANGES_KEPT, CHANGES_KEPT)).otherwise(longer)
    return out.select(
        *[c for c in state.columns if c not in (content, "history", "version", "vector_valid")],
        F.when(hit, F.col("put")).otherwise(F.col(content)).alias(content), F.when(hit, newest).otherwise(history).alias("history"),
        (F.col("version") + hit.cast("long")).alias("version"), (F.col("vector_valid") & ~hit).alias("vector_valid"))


def novelty_gate(incoming: DataFrame, best: DataFrame) -> DataFrame:
    """What becomes of each incoming row given its most similar stored row (id, lexical, semantic similarity).

    Rows of one batch are judged against the stored state, not against each other."""
    j = incoming.join(best, "id", "left")
    lex, sem = F.coalesce("lexical", F.lit(0.0)), F.coalesce("semantic", F.lit(0.0))
    return j.withColumn("verdict", F.when(lex > S.DUPLICATE, "duplicate").when(sem >= S.GATE_REINFORCE, "reinforce").when(sem >= S.GATE_UPDATE, "update").otherwise("insert"))


def split_paragraphs(df: DataFrame, key: str, text: str, least_bytes: int = 10) -> DataFrame:
    """Paragraphs (split at blank lines) of more than ``least_bytes`` bytes, with the kind their words suggest."""
    p = df.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("place", "paragraph"))
    p = p.select(key, "place", F.trim("paragraph").alias("paragraph")).where(F.octet_length("paragraph") > least_bytes)
    return p.withColumn("kind", X.classify_paragraph(F.col("paragraph")))


def upsert_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """New edges are inserted; one that exists gains 0.1 for each time it is stated, at most 1."""
    old = edges.select("src", "dst", "rtype", F.col("strength").alias("__old"))
    new = incoming.groupBy("src", "dst", "rtype").agg(F.max("strength").alias("__new"), F.count(F.lit(1)).alias("__n"))
    j = old.join(new, ["src", "dst", "rtype"], "full")
    s = F.when(F.col("__old").isNull(), F.least(F.lit(1.0), F.col("__new") + 0.1 * (F.col("__n") - 1))).otherwise(F.least(F.lit(1.0), F.col("__old") + 0.1 * F.coalesce("__n", F.lit(0))))
    return j.select("src", "dst", "rtype", s.alias("strength"))


def reinforce_from(edges: DataFrame, start: str, step: float = 0.02) -> DataFrame:
    return edges.withColumn("strength", F.when(F.col("src") == start, F.least(F.lit(1.0), F.col("strength") + step)).otherwise(F.col("strength")))


def boost_patterns(errors: DataFrame, least: int = 3) -> DataFrame:
    """Errors of a type and message class that recurs gain weight, at most 5."""
    n = errors.groupBy("error_type", "user_id").agg(F.count(F.lit(1)).alias("__n"))
    out = errors.join(n, ["error_type", "user_id"])
    return out.withColumn("synapse_weight", F.when(F.col("__n") >= least, F.least(F.lit(5.0), F.col("synapse_weight") + 0.1)).otherwise(F.col("synapse_weight"))).drop("__n")


def close_intervals(facts: DataFrame, subject: list[str], start: str = "valid_from") -> DataFrame:
    """Each fact ends where its subject's next one starts."""
    w = Window.partitionBy(*subject).orderBy(start, "id")
    return facts.withColumn("valid_to", F.lead(start).over(w)).withColumn("current", F.lead(start).over(w).isNull())


def merge_replica(local: DataFrame, incoming: DataFrame, policy: str = "merge", top: tuple[str, ...] = ("importance", "access_count"), content: str = "content") -> DataFrame:
    """Both replicas' rows by id: counters and scores take the greater value.

    ``merge`` keeps the local text and marks a differing one as a conflict; ``overwrite`` takes the incoming text and
    puts the local one into the history."""
    if policy not in ("merge", "overwrite"):
        raise ValueError(f"unknown policy {policy!r}")
    a, b = local.alias("a"), incoming.alias("b")
    j = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    differs = F.col("a.id").isNotNull() & F.col("b.id").isNotNull() & (F.col(f"a.{content}") != F.col(f"b.{content}"))
    first, second = ("a", "b") if policy == "merge" else ("b", "a")
    return j.select(
        F.coalesce("a.id", "b.id").alias("id"), F.coalesce(f"{first}.{content}", f"{second}.{content}").alias(content),
        *(F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in top),
        (differs if policy == "merge" else F.lit(False)).alias("conflict"),
        (F.when(differs, F.col(f"a.{content}")) if policy == "overwrite" else F.lit(None).cast("string")).alias("previous"))


def resolve(conflicts: DataFrame, choice: Column) -> DataFrame:
    """``ours`` closes, ``theirs`` puts the incoming text and keeps ours in the history, ``both`` keeps ours and files theirs."""
    theirs = choice == "theirs"
    return conflicts.select("id", F.when(theirs, F.col("incoming")).otherwise(F.col("content")).alias("content"), (F.col("version") + theirs.cast("long")).alias("version"),
                            F.when(theirs, F.col("content")).when(choice == "both", F.col("incoming")).alias("filed"), (~theirs).alias("vector_valid"))


def latest_version(versions: DataFrame, key: str, counter: str = "counter", actor: str = "actor") -> DataFrame:
    """Last writer wins: the row with the greatest counter, then actor, of each key."""
    fields = [c for c in versions.columns if c != key]
    best = versions.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(counter, actor)).alias("v"))
    return best.select(key, "v.*")


def bury(state: DataFrame, tombstones: DataFrame, confirm: bool = False, children: DataFrame | None = None) -> DataFrame:
    """Rows without a tombstone.  Refuses when 25 rows or more and over a tenth would go without confirmation; rows
    that still have children stay."""
    dead = tombstones.select("id").distinct()
    if children is not None:
        dead = dead.join(children.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    if not confirm:
        hit, n = state.join(dead, "id", "left_semi").count(), state.count()
        if hit >= 25 and hit > 0.1 * n:
            raise ValueError(f"{hit} of {n} rows would go; confirm to go on")
    return state.join(dead, "id", "left_anti")


def put_versions(puts: DataFrame) -> DataFrame:
    """Folds the puts of each path in order: one is accepted if its base is the current version.

    (path, seq, accepted, version): sequential per path, one path a task."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        version, out = 0, []
        for r in p.sort_values("seq").itertuples():
            ok = int(r.base) == version
            version += ok
            out.append((r.path, r.seq, ok, version))
        return pd.DataFrame(out, columns=["path", "seq", "accepted", "version"])

    return puts.groupBy("path").applyInPandas(fold, "path string, seq long, accepted boolean, version long")


def leases(requests: DataFrame, seconds: int) -> DataFrame:
    """Per path, which lock requests are granted: one holds a path until its lease runs out."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        until, holder, out = None, None, []
        for r in p.sort_values(["at", "actor"]).itertuples():
            free = until is None or r.at >= until or r.actor == holder
            if free:
                until, holder = r.at + pd.Timedelta(seconds=seconds), r.actor
            out.append((r.path, r.actor, r.at, bool(free)))
        return pd.DataFrame(out, columns=["path", "actor", "at", "granted"])

    return requests.groupBy("path").applyInPandas(fold, "path string, actor string, at timestamp_ntz, granted boolean")


def fire_triggers(triggers: DataFrame, texts: DataFrame, threshold: float = 0.5, at_once: int = 10_000) -> DataFrame:
    """Trigger state after texts were seen: a trigger fires where its pattern equals a text or resembles it, up to its
    maximum, before it expires.

    Triggers are broadcast, about ``at_once`` of them in a pass over the texts."""
    p = triggers.withColumn("__g", X.trigrams(F.col("pattern")))
    t = texts.select("content", X.trigrams(F.col("content")).alias("__t"), "at")
    passes = max(1, -(-triggers.count() // at_once))
    close = (F.col("at") < F.col("expires_at")) & ((F.col("content") == F.col("pattern")) | (X.jaccard(F.col("__g"), F.col("__t")) > threshold))
    fired = None
    for k in range(passes):
        part = p if passes == 1 else p.where(F.pmod(F.xxhash64("trigger"), F.lit(passes)) == k)
        hits = t.join(F.broadcast(part), close).groupBy("trigger").agg(F.count(F.lit(1)).alias("__f"))
        fired = hits if fired is None else fired.union(hits)
    n = F.least(F.col("max_fires"), F.col("fire_count") + F.coalesce("__f", F.lit(0)))
    return triggers.join(fired, "trigger", "left").select("trigger", n.alias("fire_count"), (n < F.col("max_fires")).alias("live"))


def chain(rows: DataFrame, group: str, order: str, payload: Column, key: bytes | None = None) -> DataFrame:
    """(group, order, hash): each hash covers the one before it; with a key the chain is sealed by HMAC.

    Sequential within a group, by folding the group's ordered payload digests."""
    digests = rows.select(group, order, F.sha2(payload, 256).alias("d"))

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        last, out = "", []
        for r in p.sort_values(order).itertuples():
            text = (last + r.d).encode()
            last = hmac.new(key, text, hashlib.sha256).hexdigest() if key else hashlib.sha256(text).hexdigest()
            out.append((getattr(r, group), getattr(r, order), last))
        return pd.DataFrame(out, columns=[group, order, "hash"])

    g, o = rows.schema[group].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    return digests.groupBy(group).applyInPandas(fold, f"{group} {g}, {order} {o}, hash string")


def erase(state: DataFrame, entity: str, needle: str, content: str = "content") -> DataFrame:
    """Without the rows of an entity and those that mention it."""
    return state.where((F.col("entity") != entity) & (F.instr(F.lower(content), needle.lower()) == 0))


def repoint(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after entities were merged: ends renamed, self-loops gone, the strongest of equal edges kept."""
    m = mapping.select("loser", "winner")
    e = edges.join(m.withColumnRenamed("loser", "src").withColumnRenamed("winner", "__s"), "src", "left").join(
        m.withColumnRenamed("loser", "dst").withColumnRenamed("winner", "__d"), "dst", "left")
    e = e.select(F.coalesce("__s", "src").alias("src"), F.coalesce("__d", "dst").alias("dst"), "rtype", "strength").where("src <> dst")
    return e.groupBy("src", "dst", "rtype").agg(F.max("strength").alias("strength"))
