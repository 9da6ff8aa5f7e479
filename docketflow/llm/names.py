"""Variant spellings of names typed by people (problem 5).

Merge-and-rematch resolution over the distinct spellings. The entries of the
directory are the first profiles. A spelling that fits exactly one profile is
merged into it, and the profile unites its spelling, nickname and initials with
its own. Richer profiles enter blocking again: open spellings that share one of
their new keys are compared again, and open spellings one letter away from a
united one are merged with it, until a round merges nothing and teaches nothing.

Blocking is an equi-join of keys: words with up to one letter left out, given
names, nicknames, initials with surname, acronyms, whole handles. A nickname
belongs to the given name beside which it was quoted, or which the sender's
address has in its place, so every bearer of that name gains it; none is known
beforehand. Facts and united spellings are tables
that are joined, without a limit to their number. No pairs of spellings are
formed: two full names meet by the name without one letter, a key that only as
many names can share as there are letters to add.

What is left open is resolved in the same way without the directory: full names
one letter apart form profiles of their own, named after the most frequent one.

Cases: null and blank names are no mentions; positions count all elements; equal
spellings are decided once; a spelling that fits several entries equally well is
not linked; an empty directory links nothing to an entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.llm.spelling import Profile, choose, form_keys, full_form, gained_keys, mention_keys, profile_keys, read_mention, same_form, told_nickname
from docketflow.operators.relate import roots
from docketflow.operators.skew import heavy_keys, salted_join
from docketflow.runtime import cut

MERGED = "k string, contributor_id bigint, cost double, nick string, initial string, form string"
#: A nickname of a given name, or an initial of an entry.
FACTS = "given string, nick string, contributor_id bigint, initial string"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows by key over as many tasks as the session has shuffle partitions; a given number is not coalesced for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


@lru_cache(maxsize=20_000)
def _profile(contributor_id: int, kind: str, name: str, note: str | None) -> Profile:
    return Profile.of(contributor_id, kind, name, note)


def directory_profiles(contributors: DataFrame) -> DataFrame:
    """(contributor_id, kind, name, note, given, surname): one row per entry with a name."""
    schema = "contributor_id bigint, kind string, name string, note string, given string, surname string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, k or "person", n, note) for c, k, n, note in zip(*(x.to_pylist() for x in b.columns))]
            yield _arrow([(*r, _profile(*r).given, _profile(*r).surname) for r in rows], schema)

    named = contributors.filter(F.trim("full_name") != "").select("contributor_id", "kind", "full_name", "affiliation")
    return cut(named.mapInArrow(run, schema), "profiles")


def _own_keys(profiles: DataFrame) -> DataFrame:
    """(key, contributor_id, nick) of the entries by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, r[0], None) for r in zip(*(c.to_pylist() for c in b.columns)) for key in sorted(profile_keys(_profile(*r)))]
            yield _arrow(rows, "key string, contributor_id bigint, nick string")

    return profiles.select("contributor_id", "kind", "name", "note").mapInArrow(run, "key string, contributor_id bigint, nick string")


def _gained(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, contributor_id, nick) that profiles gain with nicknames of their given name and with initials."""
    people = profiles.filter("kind <> 'org'")
    by_nick = people.join(facts.filter(F.col("nick").isNotNull()).select("given", "nick"), "given").select("contributor_id", "kind", "name", "note", "nick", F.lit(None).cast("string").alias("initial"))
    by_initial = people.join(facts.filter(F.col("initial").isNotNull()).select("contributor_id", "initial"), "contributor_id")
    by_initial = by_initial.select("contributor_id", "kind", "name", "note", F.lit(None).cast("string").alias("nick"), "initial")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, r[0], r[4]) for r in zip(*(c.to_pylist() for c in b.columns)) for key in sorted(gained_keys(_profile(*r[:4]), r[4], r[5]))]
            yield _arrow(rows, "key string, contributor_id bigint, nick string")

    return by_nick.unionByName(by_initial).mapInArrow(run, "key string, contributor_id bigint, nick string")


def _spelling_keys(spellings: DataFrame) -> DataFrame:
    """(k, key): a hint's keys count too, as it decides between equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text, hint in zip(*(c.to_pylist() for c in b.columns)):
                keys = mention_keys(read_mention(text)) | (mention_keys(read_mention(hint)) if hint else set())
                rows += [(k, key) for key in sorted(keys)]
            yield _arrow(rows, "k string, key string")

    return spellings.select("k", "spelling", "hint").mapInArrow(run, "k string, key string")


def _form_rows(spellings: DataFrame) -> DataFrame:
    """(k, key, form) of full names by their words in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, key, form) for k, text in zip(*(c.to_pylist() for c in b.columns)) if (form := full_form(read_mention(text))) for key in sorted(form_keys(form))]
            yield _arrow(rows, "k string, key string, form string")

    return spellings.select("k", "spelling").mapInArrow(run, "k string, key string, form string")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([same_form(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))


def _near_forms(a: DataFrame, b: DataFrame) -> DataFrame:
    """(form, other) of forms of ``a`` and ``b`` (key, form) that are the same or one letter apart."""
    met = a.select("key", "form").distinct().join(b.select("key", F.col("form").alias("other")).distinct(), "key").select("form", "other").distinct()
    return met.mapInArrow(_near, "form string, other string")


def _merge(keys: DataFrame, key_rows: DataFrame, spellings: DataFrame, profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """MERGED rows of the spellings of ``keys`` (k, key) that fit exactly one profile."""
    met = keys.join(key_rows, "key").groupBy("k", "contributor_id").agg(F.collect_set("nick").alias("nicks"))
    # initials are single letters, so an entry has as many as an alphabet at most
    known = profiles.join(facts.filter(F.col("initial").isNotNull()).groupBy("contributor_id").agg(F.collect_set("initial").alias("initials")), "contributor_id", "left")
    fields = ("contributor_id", "kind", "name", "note", "nicks", F.coalesce("initials", F.array().cast("array<string>")).alias("initials"))
    candidates = spread(met.join(known, "contributor_id"), "k").groupBy("k").agg(F.collect_list(F.struct(*fields)).alias("candidates"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text, hint, candidates in zip(*(c.to_pylist() for c in b.columns)):
                of_text = []
                for c in candidates:
                    p = _profile(c["contributor_id"], c["kind"], c["name"], c["note"])
                    of_text.append(replace(p, nicks=set(c["nicks"]) - {p.given}, initials=set(c["initials"])))
                m = read_mention(text)
                if found := choose(m, of_text, hint):
                    initial = next((middle[0] for given, middle, _ in m.readings if middle and len(given) > 1), None)
                    rows.append((k, *found, m.nick or None, initial, full_form(m) or None))
            yield _arrow(rows, MERGED)

    return cut(spellings.select("k", "spelling", "hint").join(candidates, "k").mapInArrow(run, MERGED), "merged-spellings")


def _told_nicknames(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """FACTS from ``pairs`` (spelling, local): the address holds the given name of an entry, the spelling another word with its surname.

    The other word must be nobody's given name.
    """
    schema = "given string, nick string, surname string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _arrow(sorted({(given, nick, surname) for text, local in zip(*(c.to_pylist() for c in b.columns)) for given, nick, surname in told_nickname(text, local)}), schema)

    told = pairs.mapInArrow(run, schema).distinct().join(people.select("given", "surname").distinct(), ["given", "surname"])
    return _facts(told.join(people.select(F.col("given").alias("nick")).distinct(), "nick", "left_anti").select("given", "nick").distinct())


def _facts(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c.split()[0]) if c.split()[0] in df.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in FACTS.split(", ")))


def resolve(spellings: DataFrame, contributors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, contributor_id) of the ``spellings`` (k, spelling, hint; k unique) that belong to an entry.

    ``pairs`` (spelling, local) are the names beside which an address was seen.
    """
    # spellings are short: a scan split of their file would hold millions
    spellings = spread(spellings, "k")
    profiles = directory_profiles(contributors)
    people = profiles.filter("kind <> 'org'").select("contributor_id", "given", "surname")
    facts = cut(_told_nicknames(pairs, people), "told-nicknames")
    keys, forms = cut(_spelling_keys(spellings), "spelling-keys"), cut(_form_rows(spellings), "spelling-forms")
    key_rows = cut(_own_keys(profiles).unionByName(_gained(profiles, facts)), "profile-keys")
    linked = new = _merge(keys, key_rows, spellings, profiles, facts)
    while not new.isEmpty():
        # what the profiles gain: nicknames of their given name, initials, spellings
        nicks = _facts(new.filter(F.col("nick").isNotNull()).join(people, "contributor_id").filter("nick <> given").select("given", "nick"))
        initials = _facts(new.filter(F.col("initial").isNotNull()).select("contributor_id", "initial"))
        same = [facts[c].eqNullSafe(F.col(f"t.{c}")) for c in facts.columns]
        taught = cut(nicks.unionByName(initials).distinct().alias("t").join(facts, same, "left_anti"), "taught-facts")
        facts = facts.unionByName(taught)
        gained = cut(_gained(profiles, taught), "gained-keys")
        key_rows = key_rows.unionByName(gained)
        # only open spellings that share a new key are compared again, with all their candidates
        open_keys = keys.join(linked.select("k"), "k", "left_anti")
        touched = open_keys.join(gained.select("key").distinct(), "key", "left_semi").select("k").distinct()
        again = _merge(open_keys.join(touched, "k", "left_semi"), key_rows, spellings, profiles, facts)
        # and those at most one letter away from a spelling that a profile has gained
        united = new.filter(F.col("form").isNotNull()).select(F.col("form").alias("other"), "contributor_id").distinct()
        open_forms = forms.join(linked.select("k").unionByName(again.select("k")), "k", "left_anti")
        theirs = forms.join(new.select("k"), "k", "left_semi")
        near = _near_forms(open_forms, theirs).join(united, "other")
        one = near.groupBy("form").agg(F.min("contributor_id").alias("contributor_id"), F.max("contributor_id").alias("last")).filter("contributor_id = last").drop("last")
        none = F.lit(None).cast("string")
        by_form = cut(open_forms.select("k", "form").distinct().join(one, "form").select("k", "contributor_id", F.lit(1.0).alias("cost"), none.alias("nick"), none.alias("initial"), "form"), "merged-forms")
        new = again.unionByName(by_form)
        linked = linked.unionByName(new)
    return linked.select("k", "contributor_id")


def outside_profiles(spellings: DataFrame, linked: DataFrame) -> DataFrame:
    """(k, profile) of full names that belong to no entry: each goes to the most frequent name one letter away, and on to that one's.

    ``spellings`` (k, spelling, n), ``linked`` (k).
    """
    open_ = spellings.join(linked.select("k"), "k", "left_anti")
    forms = cut(_form_rows(spread(open_, "k")), "open-forms")
    counted = cut(forms.select("k", "form").distinct().join(open_, "k").groupBy("form").agg(F.sum("n").alias("n")), "open-form-counts")
    rank = F.struct(F.col("m").alias("n"), F.col("other").alias("form"))
    near = _near_forms(forms, forms).filter("form <> other").join(counted.select(F.col("form").alias("other"), F.col("n").alias("m")), "other")
    best = near.groupBy("form").agg(F.max(rank).alias("best"))
    edges = counted.join(best, "form", "left").select(F.col("form").alias("id"), F.when(F.col("best") > F.struct("n", "form"), F.col("best.form")).alias("parent"))
    return forms.select("k", "form").distinct().join(roots(edges).select(F.col("id").alias("form"), F.col("root").alias("profile")), "form").select("k", "profile")


def _spelled(mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mentions with their trimmed spelling and key, the distinct spellings with their counts, and those with an address."""
    trim = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = mentions.select("tab", "fld", "row_id", "pos", "text", "hint").withColumn("spelling", trim).filter(F.col("spelling") != "")
    lone = ~F.col("spelling").rlike(r"(?U)\s")
    rows = rows.withColumn("local", F.when(~lone, F.col("hint"))).withColumn("hint", F.when(lone, F.col("hint"))).drop("text")
    rows = cut(rows.withColumn("k", F.concat_ws("\u0001", "spelling", F.coalesce("hint", F.lit("")))), "mentions")
    counted = cut(rows.groupBy("k", "spelling", "hint").agg(F.count(F.lit(1)).alias("n")), "spelling-counts")
    return rows, counted, rows.filter(F.col("local").isNotNull()).select("spelling", "local").distinct()


def link(mentions: DataFrame, contributors: DataFrame) -> DataFrame:
    """(tab, fld, row_id, pos, spelling, contributor_id) of ``mentions`` (tab, fld, row_id, pos, text, hint).

    hint is other evidence for a lone word, such as an address's local part.
    """
    rows, counted, pairs = _spelled(mentions)
    found = salted_join(rows, resolve(counted, contributors, pairs), heavy_keys(counted, "k"), "k", ["row_id", "pos"])
    return found.select("tab", "fld", "row_id", "pos", "spelling", "contributor_id")


def link_all(mentions: DataFrame, contributors: DataFrame) -> DataFrame:
    """(tab, fld, row_id, pos, spelling, contributor_id, profile): as ``link``, and full names of others with the name of their profile."""
    rows, counted, pairs = _spelled(mentions)
    linked = cut(resolve(counted, contributors, pairs), "linked-spellings")
    none = F.lit(None).cast("string")
    both = linked.select("k", "contributor_id", none.alias("profile")).unionByName(outside_profiles(counted, linked).select("k", F.lit(None).cast("bigint").alias("contributor_id"), "profile"))
    return salted_join(rows, both, heavy_keys(counted, "k"), "k", ["row_id", "pos"]).select("tab", "fld", "row_id", "pos", "spelling", "contributor_id", "profile")
