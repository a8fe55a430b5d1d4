"""People, topics and organizations of a set of messages, as nodes and edges.

Rows: message_id, conversation_id, sender, sender_name, subject, body, document, email_type, date, is_replied.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions.text import normalize_subject
from postloom.operators.manifest import Manifest
from postloom.operators.phrases import tagged

# Fixed values.
FREEMAIL = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "live.com", "aol.com", "icloud.com", "me.com", "msn.com", "googlemail.com", "protonmail.com")
ACTIONS = (r"(?i)(?:^|\n)\s*(?:action[:\s]|todo[:\s]|to.do[:\s])(.+)", r"(?i)(?:please|pls|kindly)\s+(.{10,80}?)[\.\n]", r"(?i)(?:will|going to|need to|have to|must|should)\s+(.{10,80}?)[\.\n]", r"(?i)(?:deadline|due(?:\s+date)?)[:\s]+(.{5,60})")
MOODS = {"urgent": "urgent", "asap": "urgent", "critical": "urgent", "risk": "risk", "blocked": "blocked", "blocker": "blocked", "overdue": "overdue", "waiting on": "waiting", "waiting for": "waiting", "no response": "waiting"}


def address(sender: Column) -> Column:
    return F.lower(F.trim(sender))


def people(messages: DataFrame) -> DataFrame:
    """person, n, name: the first name by date that is not the address itself, else the address."""
    m = messages.where("coalesce(email_type, '') <> 'meeting_note' and coalesce(sender, '') <> ''").withColumn("person", address(F.col("sender")))
    bare = F.lower(F.trim(F.coalesce("sender_name", F.lit("")))).isin("") | (F.lower(F.trim("sender_name")) == F.col("person"))
    best = F.min(F.struct(bare.alias("bare"), "date", "message_id", F.col("sender_name").alias("name")))
    return m.groupBy("person").agg(F.count("*").alias("n"), best.alias("b")).select("person", "n", F.when(F.col("b.bare"), F.col("person")).otherwise(F.col("b.name")).alias("name"))


def is_relevant(subject: Column, question: str) -> Column:
    words = [w for w in question.lower().split() if len(w) >= 2]
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(subject), w)) if words else F.lit(False)


def topics(messages: DataFrame, question: str) -> DataFrame:
    """topic, n, threads of normalized subjects that hold a word of the question."""
    t = messages.withColumn("topic", normalize_subject(F.col("subject"))).where(F.col("topic") != "").where(is_relevant(F.col("topic"), question))
    return t.groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct(F.nullif("conversation_id", F.lit(""))).alias("threads"))


def organizations(persons: DataFrame) -> DataFrame:
    """domain, label, members, n of domains of two people or more that are not free mail."""
    d = persons.where(F.size(F.split("person", "@")) == 2).withColumn("domain", F.split_part("person", F.lit("@"), F.lit(2))).where(~F.col("domain").isin(*FREEMAIL))
    return d.groupBy("domain").agg(F.count("*").alias("members"), F.sum("n").alias("n")).where("members >= 2").withColumn("label", F.initcap(F.split_part("domain", F.lit("."), F.lit(1))))


def cutoffs(counts: DataFrame) -> DataFrame:
    """One row, high and low: the counts at two and one thirds of the sorted counts, which must be few enough to sort in one row: counts are grouped by value first."""
    each = counts.groupBy("n").agg(F.count("*").alias("times"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("upto", F.sum("times").over(w))
    total = counts.agg(F.count("*").alias("total"))
    at = placed.join(F.broadcast(total))
    pick = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col("n")))
    return at.agg(F.when(F.max("total") >= 3, pick(0.66)).otherwise(F.coalesce(F.max("n"), F.lit(1))).alias("high"), F.when(F.max("total") >= 3, pick(0.33)).otherwise(F.lit(1)).alias("low"))


def tiers(counts: DataFrame, by: DataFrame) -> DataFrame:
    return counts.join(F.broadcast(by)).withColumn("tier", F.when(F.col("n") >= F.col("high"), "A").when(F.col("n") >= F.col("low"), "B").otherwise("C")).drop("high", "low")


def entity_nodes(messages: DataFrame, question: str) -> DataFrame:
    """id, type, label, n, tier of people, topics and organizations. People and organizations share the people's cutoffs, topics have their own."""
    p, t = people(messages), topics(messages, question)
    by = cutoffs(p)
    node = lambda rows, key, kind, label: rows.select(F.concat(F.lit(f"{kind}_"), key).alias("id"), F.lit(kind).alias("type"), label.alias("label"), "n")
    return tiers(node(p, "person", "person", F.col("name")), by).unionByName(tiers(node(t, "topic", "topic", F.substring("topic", 1, 50)), cutoffs(t))).unionByName(tiers(node(organizations(p), "domain", "organization", F.col("label")), by))


def entity_stats(messages: DataFrame, question: str) -> DataFrame:
    """One row: people, topics, organizations, connections (edges of the three kinds), total_emails."""
    p, t = people(messages), topics(messages, question)
    orgs = organizations(p)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    edges = person_pairs(messages).select("src").unionByName(person_topics(messages, p, t).select(F.col("person").alias("src"))).unionByName(person_orgs(p, orgs).select(F.col("person").alias("src")))
    return count(p, "people").join(count(t, "topics")).join(count(orgs, "organizations")).join(count(edges, "connections")).join(count(messages, "total_emails"))


def action_items(messages: DataFrame, most: int | None = 5, chars: int | None = 120) -> DataFrame:
    """person, item, place: distinct items of each sender by message, pattern and place in the text; the first `most`, of the first `chars` characters each, as a node shows them. None for all, and for whole items."""
    short = lambda c: c if chars is None else F.substring(c, 1, chars)

    def by_pattern(k: int) -> Column:
        return F.transform(F.regexp_extract_all(F.col("body"), F.lit(ACTIONS[k]), F.lit(1)), lambda s, i: F.struct(F.lit(k).alias("k"), i.alias("i"), short(F.regexp_replace(s, r"^\s+|\s+$", "")).alias("item")))

    found = F.flatten(F.array(*map(by_pattern, range(len(ACTIONS)))))
    each = messages.where("coalesce(sender, '') <> '' and coalesce(body, '') <> ''").select(address(F.col("sender")).alias("person"), "date", "message_id", F.explode(found).alias("f")).where("f.item <> ''")
    first = each.groupBy("person", F.col("f.item").alias("item")).agg(F.min(F.struct("date", "message_id", "f.k", "f.i")).alias("at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("person").orderBy("at")))
    return (placed if most is None else placed.where(F.col("place") <= most)).select("person", "item", F.col("place").cast("long").alias("place"))


def moods(messages: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """person, tags (sorted, comma-joined) of what each sender wrote. `words` (phrase, tag) in place of MOODS: a table of any size, found in one pass."""
    said = messages.where("coalesce(sender, '') <> '' and coalesce(body, '') <> ''")
    if words is not None:
        each = tagged(said.withColumn("person", address(F.col("sender"))), words, "person").distinct()
    else:
        tags = F.array_compact(F.array(*[F.when(F.contains(F.lower("body"), F.lit(w)), F.lit(t)) for w, t in MOODS.items()]))
        each = said.select(address(F.col("sender")).alias("person"), F.explode(tags).alias("tag")).distinct()
    return each.groupBy("person").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))


def thread_counts(messages: DataFrame, chars: int | None = 200) -> DataFrame:
    """conversation_id, replies (messages replied to), quotes (messages whose document holds a '>' in its first `chars` characters, or anywhere)."""
    text = F.col("document") if chars is None else F.substring("document", 1, chars)
    return messages.where("coalesce(conversation_id, '') <> ''").groupBy("conversation_id").agg(F.count_if("is_replied").alias("replies"), F.count_if(F.contains(text, F.lit(">"))).alias("quotes"))


#: People of a thread whose pairs one task makes; larger threads are cut in groups of so many.
GROUP = 64


def _members(messages: DataFrame) -> DataFrame:
    """conversation_id, person of each thread's senders, once."""
    m = messages.where("coalesce(email_type, '') <> 'meeting_note' and coalesce(conversation_id, '') <> '' and coalesce(sender, '') <> ''")
    return m.select("conversation_id", address(F.col("sender")).alias("person")).distinct()


def _pairs(p: DataFrame) -> DataFrame:
    """conversation_id, src < dst of members. A thread's people are dealt to groups of about GROUP, and two groups meet in one task, so a thread of many people is shared among many tasks."""
    groups = p.groupBy("conversation_id").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = p.join(groups, "conversation_id").withColumn("mine", F.pmod(F.xxhash64("person"), "groups").cast("int"))
    each = lambda name, low, high: dealt.select("conversation_id", F.col("person").alias(name), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"), "mine").select("conversation_id", name, F.col(low).alias("g"), F.col(high).alias("h"))
    return each("src", "mine", "other").join(each("dst", "other", "mine"), ["conversation_id", "g", "h"]).where("src < dst").select("conversation_id", "src", "dst")


def pair_threads(messages: DataFrame) -> DataFrame:
    """src, dst, conversation_id: a row for each thread of a pair. Pairs of a thread follow from what is asked."""
    return _pairs(_members(messages)).select("src", "dst", "conversation_id")


def person_pairs(messages: DataFrame, with_threads: bool = False) -> DataFrame:
    """src < dst, weight (threads of both), replies, quotes (messages whose document holds a '>' anywhere); and thread_ids (sorted) if asked for. pair_threads() has the threads as rows."""
    ids = [F.sort_array(F.collect_list("conversation_id")).alias("thread_ids")] if with_threads else []
    return pair_threads(messages).join(thread_counts(messages, None), "conversation_id").groupBy("src", "dst").agg(F.count("*").alias("weight"), F.sum("replies").alias("replies"), F.sum("quotes").alias("quotes"), *ids)


def _topic_threads(messages: DataFrame, persons: DataFrame, topic_nodes: DataFrame) -> DataFrame:
    e = messages.where("coalesce(sender, '') <> ''").select(address(F.col("sender")).alias("person"), normalize_subject(F.col("subject")).alias("topic"), F.nullif("conversation_id", F.lit("")).alias("thread")).join(topic_nodes.select("topic"), "topic").join(persons.select("person"), "person", "left_semi")
    return e.groupBy("person", "topic", "thread").agg(F.count("*").alias("n"))


def topic_threads(messages: DataFrame, persons: DataFrame, topic_nodes: DataFrame) -> DataFrame:
    """person, topic, thread, n (messages): a row for each thread of a person and topic."""
    return _topic_threads(messages, persons, topic_nodes).where("thread is not null")


def person_topics(messages: DataFrame, persons: DataFrame, topic_nodes: DataFrame, with_threads: bool = False) -> DataFrame:
    """person, topic, weight (messages), threads; and thread_ids (sorted) if asked for; both ends are nodes. topic_threads() has the threads as rows."""
    ids = [F.sort_array(F.collect_list("thread")).alias("thread_ids")] if with_threads else []
    return _topic_threads(messages, persons, topic_nodes).groupBy("person", "topic").agg(F.sum("n").alias("weight"), F.count("thread").alias("threads"), *ids)


def person_orgs(persons: DataFrame, orgs: DataFrame) -> DataFrame:
    return persons.withColumn("domain", F.split_part("person", F.lit("@"), F.lit(2))).join(orgs.select("domain"), "domain").select("person", "domain", F.lit(1).alias("weight"))


def topic_map_nodes(messages: DataFrame) -> DataFrame:
    """id, type, label, n: threads, people, and messages without a thread."""
    threads = messages.where("coalesce(conversation_id, '') <> ''").groupBy("conversation_id").agg(F.max_by("subject", F.struct("date", "message_id")).alias("s"), F.count("*").alias("n")).select(F.concat(F.lit("thread_"), "conversation_id").alias("id"), F.lit("thread").alias("type"), F.substring("s", 1, 40).alias("label"), "n")
    persons = people(messages).select(F.concat(F.lit("person_"), "person").alias("id"), F.lit("person").alias("type"), F.col("name").alias("label"), "n")
    alone = messages.where("coalesce(conversation_id, '') = ''").select(F.concat(F.lit("email_"), "message_id").alias("id"), F.lit("email").alias("type"), F.substring("subject", 1, 40).alias("label"), F.lit(1).cast("long").alias("n"))
    return threads.unionByName(persons).unionByName(alone)


def topic_map_edges(messages: DataFrame) -> DataFrame:
    m = messages.where("coalesce(email_type, '') <> 'meeting_note' and coalesce(sender, '') <> ''").withColumn("src", F.concat(F.lit("person_"), address(F.col("sender"))))
    part = m.where("coalesce(conversation_id, '') <> ''").select("src", F.concat(F.lit("thread_"), "conversation_id").alias("dst"), F.lit("participated").alias("type")).distinct()
    sent = m.where("coalesce(conversation_id, '') = ''").select("src", F.concat(F.lit("email_"), "message_id").alias("dst"), F.lit("sent").alias("type")).distinct()
    return part.unionByName(sent)


def visible(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass, and edges both of whose ends do."""
    shown = nodes.where(keep)
    ids = shown.select("id")
    return shown, edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def node_sizes(nodes: DataFrame) -> DataFrame:
    """Sizes by tier (A 30 to 45, B 20 to 30, C 12 to 20), growing with the share of the largest of the type and tier."""
    most = nodes.groupBy("type", "tier").agg(F.max("n").alias("peak"))
    low = F.when(F.col("tier") == "A", 30).when(F.col("tier") == "B", 20).otherwise(12)
    high = F.when(F.col("tier") == "A", 45).when(F.col("tier") == "B", 30).otherwise(20)
    return nodes.join(F.broadcast(most), ["type", "tier"]).withColumn("size", F.round(low + (high - low) * F.col("n") / F.col("peak"), 4)).drop("peak")


def edge_widths(edges: DataFrame, most: float = 8.0) -> DataFrame:
    """pair (both ends, sorted), weight and width of the edges between two nodes, taken together: a width of 1 and half a weight more, capped."""
    pair = F.array_join(F.array_sort(F.array("src", "dst")), "|")
    return edges.groupBy(pair.alias("pair")).agg(F.sum("weight").alias("weight")).withColumn("width", F.least(F.lit(most), 1 + F.col("weight") * 0.5))


@dataclass(frozen=True)
class EdgeView:
    """Edges between people, kept up batch by batch: each batch adds its new members of threads, its counts by thread, and signed changes of edges, made of the threads it touches only. Edges are the sums of the changes. Quotes are those of thread_counts() by default, in the first 200 characters; person_pairs() looks at whole documents."""

    spark: SparkSession
    path: str

    def _manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.path.rstrip('/')}/versions")

    def _read(self, name: str, shape: str) -> DataFrame:
        parts = self._manifest().read()[1].get("parts", [])
        return self.spark.read.schema(shape).parquet(*[f"{self.path}/{p}/{name}" for p in parts]) if parts else self.spark.createDataFrame([], shape)

    @property
    def members(self) -> DataFrame:
        """conversation_id, person"""
        return self._read("members", "conversation_id string, person string")

    @property
    def counts(self) -> DataFrame:
        """conversation_id, replies, quotes, by batch: to be added up."""
        return self._read("counts", "conversation_id string, replies long, quotes long")

    @property
    def edges(self) -> DataFrame:
        """src, dst, weight, replies, quotes"""
        changes = self._read("changes", "src string, dst string, weight long, replies long, quotes long")
        return changes.groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in ("weight", "replies", "quotes")]).where("weight > 0")

    def add(self, messages: DataFrame, batch: str) -> bool:
        """Adds messages that aren't in it yet. A batch whose name is there already is left out; of two writers one gets a Conflict."""
        at, held = self._manifest().read()
        parts = held.get("parts", [])
        if batch in parts:
            return False
        place = f"{self.path}/{batch}"
        came, news = _members(messages), thread_counts(messages)
        touched = news.select("conversation_id")
        old = self.members.join(touched, "conversation_id", "left_semi")
        came.join(old, ["conversation_id", "person"], "left_anti").write.mode("overwrite").parquet(f"{place}/members")
        news.write.mode("overwrite").parquet(f"{place}/counts")
        fresh = self.spark.read.parquet(f"{place}/members")
        before = self.counts.join(touched, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.sum("replies").alias("replies"), F.sum("quotes").alias("quotes"))
        after = before.unionByName(news).groupBy("conversation_id").agg(F.sum("replies").alias("replies"), F.sum("quotes").alias("quotes"))
        gained = _pairs(old.unionByName(fresh)).join(after, "conversation_id").select("src", "dst", F.lit(1).alias("weight"), "replies", "quotes")
        lost = _pairs(old).join(before, "conversation_id").select("src", "dst", F.lit(-1).alias("weight"), (-F.col("replies")).alias("replies"), (-F.col("quotes")).alias("quotes"))
        changes = gained.unionByName(lost).groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in ("weight", "replies", "quotes")])
        changes.where("weight <> 0 or replies <> 0 or quotes <> 0").write.mode("overwrite").parquet(f"{place}/changes")
        self._manifest().commit(at, {"parts": [*parts, batch]})
        return True
