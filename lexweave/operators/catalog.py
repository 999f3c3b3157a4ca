"""Joins of text with a catalog of translations: render, audit, compare and merge."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexweave.functions import markup as M
from lexweave.functions.particles import polish
from lexweave.operators import inventory as I
from lexweave.shipping import ship
from lexweave.storage import stored

#: Characters of a key that tell ranges of a catalog apart.
RANGE_CHARS = 10
UNIT = "template string, korean string, rep string, class string, members long, pos long"
# The rules that are errors.
ERRORS = (
    "non-ascii-path bad-filename missing-bom bad-header replace-dir unknown-key shadows-baseline layer-mismatch "
    "leaked-placeholder empty-translation token-mismatch do-not-translate"
).split()
FINDING = "severity string, rule string, key string, file string, line int, message string, source string, translation string"


def from_groups(grouped: DataFrame) -> DataFrame:
    """An untranslated catalog of the groups, in catalog order (O-72, O-77, O-95)."""
    return numbered(grouped.select("template", F.lit("").alias("korean"), "rep", "class", F.col("members").cast("long")))


def numbered(units: DataFrame) -> DataFrame:
    """Positions by (class, rep), ties by earlier position (O-77).

    Units are ranked side by side in ranges of (class, beginning of the representative key), which are
    shifted by the counts before them, so no task sorts a catalog.
    """
    ties = ["pos"] if "pos" in units.columns else ["template"]
    rows = units.withColumn("_range", F.struct("class", F.left("rep", F.lit(RANGE_CHARS)).alias("start")))
    shift = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    shifts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", shift.alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("rep", *ties)) - 1
    ranked = rows.withColumn("_rank", rank).join(shifts, "_range")
    return ranked.withColumn("_at", (F.col("_shift") + F.col("_rank")).cast("long")).drop("pos", "_range", "_rank", "_shift").withColumnRenamed("_at", "pos")


def last_units(catalog: DataFrame) -> DataFrame:
    """One unit for each template, the last one."""
    row = F.struct("pos", *(c for c in catalog.columns if c not in ("pos", "template")))
    return catalog.groupBy("template").agg(F.max(row).alias("r")).select("template", "r.*")


def translated(catalog: DataFrame) -> DataFrame:
    """Units that have a translation (O-44)."""
    return catalog.where("korean <> ''")


def pending(catalog: DataFrame, again: bool = False, limit: int = 0) -> DataFrame:
    """Units that need a translation, in order (O-43, O-81). The template stands for the value, as its identifiers never match."""
    todo = F.lit(True) if again else F.col("korean") == ""
    out = catalog.where((F.col("class") == "prose") & todo & ~M.do_not_translate(F.col("rep"), F.col("template")))
    return out.orderBy("pos").limit(limit) if limit else out


def bind(entries: DataFrame) -> DataFrame:
    """(key, template, tokens, numbers): the last group, by size and template, that holds a key (O-53).

    A key's rows in one group become one before they meet the group's size; the numbered template is made
    once for each group.
    """
    v = F.col("value")
    rows = entries.where(v.isNotNull()).select("key", M.skeleton(v).alias("skeleton"), M.tokens(v).alias("tokens"), M.numbers(v).alias("numbers"))
    held = rows.groupBy("key", "skeleton").agg(F.max(F.struct("tokens", "numbers")).alias("own"))
    sizes = rows.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).select("skeleton", "n", M.template_of(F.col("skeleton")).alias("template"))
    row = F.struct((-F.col("n")).alias("order"), "template", "own.tokens", "own.numbers")
    last = held.join(sizes, "skeleton").groupBy("key").agg(F.max(row).alias("r"))
    return last.select("key", "r.template", "r.tokens", "r.numbers")


def render(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every row with its rendered text and state (O-54, O-71, O-87).

    Adds ``text``, and the flags do_not_touch, translated, english and fell_back. Translated is a text that
    differs from its source, english any other, also a translation that equals it; fell_back is a
    translation that broke a rule and was replaced by its source. A row whose placeholders can't be filled
    keeps its source and counts as english only.
    """
    known = last_units(translated(catalog)).select("template", "korean")
    filled = M.detemplatize(F.col("korean"), F.col("tokens"), F.col("numbers"))
    # a key's text is filled and polished once, for all its rows
    texts = bind(entries).join(known, "template").select("key", filled.alias("_f")).where("_f.ok").select("key", polish(F.col("_f.value")).alias("_said"))
    key, value = F.col("key"), F.col("value")
    rows = entries.join(texts, "key", "left").withColumn("_keep", M.do_not_translate(key, value))
    rows = rows.withColumn("_t", F.when(~F.col("_keep"), F.col("_said")))
    differs = F.coalesce(F.col("_t") != value, F.lit(False))
    rows = rows.withColumn("_ok", F.when(differs, M.sound(key, value, F.col("_t"))))
    done, fell = F.coalesce(F.col("_ok"), F.lit(False)), F.coalesce(~F.col("_ok"), F.lit(False))
    return rows.select(
        *entries.columns,
        F.when(done, F.col("_t")).otherwise(value).alias("text"),
        F.col("_keep").alias("do_not_touch"),
        done.alias("translated"),
        (~done).alias("english"),
        fell.alias("fell_back"),
    )


def build_stats(rendered: DataFrame) -> DataFrame:
    """One row of counts over rendered rows (O-71)."""
    flags = ("translated", "english", "do_not_touch", "fell_back")
    return rendered.agg(
        F.count(F.lit(1)).alias("keys"),
        *(F.count_if(F.col(f)).alias(f) for f in flags),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
    )


def findings(source: DataFrame, pack: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Broken rules of a pack against its source and baseline (O-55 to O-57, O-84, O-86).

    The source's first definition of a key counts. A key that the source lacks is reported once as unknown
    and judged no further; one with a broken text isn't called untranslated as well.
    """
    first = I.first_rows(source.select("key", "file", "line", "layer", "value"), "key", "file", "line")
    first = first.select("key", F.col("layer").alias("_layer"), F.col("value").alias("_source"), F.lit(True).alias("_known"))
    rows = pack.join(first, "key", "left")
    if baseline is not None:
        mine = I.first_rows(baseline, "key", "ordinal", "file").select("key", F.col("file").alias("_base"))
        rows = rows.join(mine, "key", "left")
    else:
        rows = rows.withColumn("_base", F.lit(None).cast("string"))
    known, broken = F.col("_known").isNotNull(), M.check_pair(F.col("key"), F.col("_source"), F.col("value"))
    note = lambda rule, message: F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message"))
    same = (F.col("value") == F.col("_source")) & (M.classify(F.col("_source")) == "prose")
    plain = same & ~M.do_not_translate(F.col("key"), F.col("_source"))
    hits = F.concat(
        F.array_compact(F.array(F.when(M.in_replace(F.col("file")), note("replace-dir", "under replace/")))),
        F.when(~known, F.array(note("unknown-key", "not a key of the source"))).otherwise(
            F.concat(
                F.array_compact(
                    F.array(
                        F.when(F.col("_base").isNotNull(), note("shadows-baseline", "also a key of the baseline")),
                        F.when((F.col("_layer") != "") & (F.col("_layer") != F.col("layer")), note("layer-mismatch", "in another layer than the source")),
                    )
                ),
                F.when(F.size(broken) > 0, broken).otherwise(F.array_compact(F.array(F.when(plain, note("untranslated", "same as the source"))))),
            )
        ),
    )
    per_row = rows.select("key", "file", "line", F.col("_source").alias("source"), F.col("value").alias("translation"), F.explode(hits).alias("h"))
    per_row = per_row.select(severity("h.rule"), "h.rule", "key", "file", "line", "h.message", "source", "translation")
    text = lambda s: F.lit(s).cast("string")
    twice = I.duplicates(pack).select(F.lit("duplicate-key").alias("rule"), "key", text("").alias("file"), F.lit(0).alias("line"), F.array_join("places", ", ").alias("message"), text("").alias("source"), text("").alias("translation"))
    out = per_row.unionByName(twice.withColumn("severity", severity("rule")))
    if "malformed" in source.columns:
        bad = source.where("malformed").select(F.lit("malformed-source").alias("rule"), "key", "file", "line", F.lit("no closing quote").alias("message"), F.col("value").alias("source"), text("").alias("translation"))
        out = out.unionByName(bad.withColumn("severity", severity("rule")))
    return out


def severity(rule: str):
    return F.when(F.col(rule).isin(*ERRORS), "error").otherwise("warn").alias("severity")


def file_findings(files: DataFrame, language: str) -> DataFrame:
    """Broken rules of a pack's files: folder, byte order mark and header (O-45)."""
    note = lambda when, rule, message: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message")))
    hits = F.array_compact(
        F.array(
            note(~F.col("path").contains(f"/localization/{language}/"), "bad-filename", f"not under /localization/{language}/"),
            note(~F.col("had_bom"), "missing-bom", "no byte order mark"),
            note(F.col("language") != language, "bad-header", f"header is not l_{language}"),
        )
    )
    rows = files.select("path", F.explode(hits).alias("h"))
    return rows.select(severity("h.rule"), "h.rule", F.lit("").alias("key"), F.col("path").alias("file"), F.lit(0).alias("line"), "h.message", F.lit("").alias("source"), F.lit("").alias("translation"))


def by_rule(found: DataFrame) -> DataFrame:
    """(rule, n, severity) (O-68)."""
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("severity").alias("severity"))


def severities(found: DataFrame) -> DataFrame:
    """One row of error and warning counts (O-69)."""
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))


def fallback_keys(found: DataFrame) -> DataFrame:
    """Distinct keys whose text falls back to the source (O-74)."""
    return found.where(F.col("rule").isin("leaked-placeholder", "empty-translation", "token-mismatch", "do-not-translate")).select("key").distinct()


def shadowed(source: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distinct source keys that the baseline has (O-51)."""
    return source.select("key").distinct().join(baseline.select("key"), "key", "left_semi")


def added_keys(source: DataFrame, pack: DataFrame) -> DataFrame:
    """Source keys that the pack lacks, repeats included; swap the two for removed keys (O-50)."""
    return source.select("key").join(pack.select("key").distinct(), "key", "left_anti")


def compare(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, template, rep, class, members, previous_template, previous_korean) of each change (O-58, O-59, O-88).

    Kinds: unchanged, untranslated (unchanged prose without translation), new, changed, orphaned. A new
    template takes over the first orphan, by catalog position, whose representative key it now holds.
    """
    v = F.col("value")
    # rows are read once: all else comes from the groups that hold each key
    held = stored(entries.where(v.isNotNull()).groupBy("key", M.skeleton(v).alias("skeleton")).agg(F.count(F.lit(1)).alias("n")))
    sizes = stored(held.groupBy("skeleton").agg(F.min("key").alias("rep"), F.sum("n").alias("members")))
    now = I.described(sizes)
    units = last_units(catalog).select("template", "korean")
    orphans = catalog.join(now.select("template"), "template", "left_anti")
    named = sizes.select("skeleton", F.col("members").alias("n"), M.template_of(F.col("skeleton")).alias("template"))
    last = held.select("key", "skeleton").join(named, "skeleton").groupBy("key").agg(F.max(F.struct((-F.col("n")).alias("order"), "template")).alias("r"))
    holds = last.select(F.col("key").alias("rep"), F.col("r.template").alias("_new"))
    # every template that holds a key is a current one, so new is what the catalog lacks
    claims = orphans.join(holds, "rep").join(units.select(F.col("template").alias("_new")), "_new", "left_anti")
    wins = claims.groupBy("_new").agg(F.min(F.struct("pos", "template", "korean")).alias("w"))
    taken = wins.select(F.col("_new").alias("template"), "w")
    rows = now.join(units, "template", "left").join(taken, "template", "left")
    none, known = F.lit(""), F.col("korean").isNotNull()
    kind = (
        F.when(known & (F.col("korean") == "") & (F.col("class") == "prose"), "untranslated")
        .when(known, "unchanged")
        .when(F.col("w").isNotNull(), "changed")
        .otherwise("new")
    )
    facts = ("template", "rep", "class", F.col("members").cast("long").alias("members"))
    current = rows.select(
        kind.alias("kind"),
        *facts,
        F.coalesce("w.template", none).alias("previous_template"),
        F.coalesce("korean", "w.korean", none).alias("previous_korean"),
    )
    left = orphans.join(wins.select("w.pos"), "pos", "left_anti")
    gone = left.select(F.lit("orphaned").alias("kind"), *facts, none.alias("previous_template"), F.col("korean").alias("previous_korean"))
    return current.unionByName(gone)


def change_counts(changes: DataFrame) -> DataFrame:
    """One row of changes by kind (O-88); untranslated units are unchanged ones, too."""
    kind = F.col("kind")
    return changes.agg(
        F.count_if(kind.isin("unchanged", "untranslated")).alias("unchanged"),
        *(F.count_if(kind == k).alias(k) for k in ("untranslated", "new", "changed", "orphaned")),
    )


def work(changes: DataFrame) -> DataFrame:
    """One row: units that need a translation (O-75)."""
    return changes.agg(F.count_if(F.col("kind").isin("new", "changed", "untranslated")).alias("work"))


def merge(grouped: DataFrame, catalog: DataFrame, prune: bool = False) -> DataFrame:
    """The catalog of the current groups: translations kept, facts refreshed, orphans kept or pruned (O-89).

    Adds ``state``: added, kept, refreshed or orphan. No full outer join: an orphan with a repeated
    template stays as often as it stands.
    """
    old = last_units(catalog).select("template", "korean", F.col("rep").alias("_rep"), F.col("class").alias("_class"), F.col("members").alias("_members"), F.col("pos").alias("_pos"))
    rows = grouped.select("template", "rep", "class", F.col("members").cast("long").alias("members")).join(old, "template", "left")
    same = (F.col("rep") == F.col("_rep")) & (F.col("class") == F.col("_class")) & (F.col("members") == F.col("_members"))
    state = F.when(F.col("_pos").isNull(), "added").when(same, "kept").otherwise("refreshed")
    units = rows.select("template", F.coalesce("korean", F.lit("")).alias("korean"), "rep", "class", "members", F.coalesce("_pos", F.lit(-1)).alias("pos"), state.alias("state"))
    if not prune:
        orphans = catalog.join(grouped.select("template"), "template", "left_anti")
        units = units.unionByName(orphans.select("template", "korean", "rep", "class", "members", "pos", F.lit("orphan").alias("state")))
    return units


def merge_stats(catalog: DataFrame, grouped: DataFrame, merged: DataFrame, prune: bool = False) -> DataFrame:
    """One row: added, kept, refreshed (also kept) and pruned units (O-89)."""
    gone = catalog.join(grouped.select("template"), "template", "left_anti").where(F.lit(prune)).agg(F.count(F.lit(1)).alias("pruned"))
    s = F.col("state")
    own = merged.agg(F.count_if(s == "added").alias("added"), F.count_if(s.isin("kept", "refreshed")).alias("kept"), F.count_if(s == "refreshed").alias("refreshed"))
    return own.withColumn("_one", F.lit(1)).join(gone.withColumn("_one", F.lit(1)), "_one").drop("_one")


def polish_catalog(catalog: DataFrame) -> DataFrame:
    """Translated units with settled particles, and whether that changed them (O-94)."""
    fixed = polish(F.col("korean"))
    return translated(catalog).withColumn("polished", fixed).withColumn("changed", fixed != F.col("korean"))


def relevant_terms(texts: DataFrame, glossary: DataFrame, batch: str = "batch", text: str = "text", most: int = 10_000) -> DataFrame:
    """(batch, term, rendering): glossary terms that a batch's texts contain, ignoring case (O-60).

    Containment has no equality to join on: an automaton finds all terms in one pass over each text. A
    glossary of more than about ``most`` terms is taken in blocks by a hash, so none is ever refused.
    Null texts and terms match nothing; the empty term is in every text.
    """
    ship(texts.sparkSession)
    known = glossary.where(F.col("term").isNotNull()).select("term", "rendering", F.lower("term").alias("low"))
    blocks = max(1, -(-known.count() // most))
    low = texts.where(F.col(text).isNotNull()).select(F.col(batch).alias("batch"), F.lower(text).alias("text"))
    schema = StructType([StructField("batch", low.schema["batch"].dataType), StructField("term", StringType()), StructField("rendering", StringType())])
    parts = []
    for b in range(blocks):
        rows = [tuple(r) for r in known.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == b).collect()]
        parts.append(low.mapInArrow(_finder(texts.sparkSession.sparkContext.broadcast(rows)), schema))
    return reduce(DataFrame.unionByName, parts).distinct().withColumnRenamed("batch", batch)


def _finder(shared):
    """A map over (batch, text) that gives a row for each term of ``shared`` in a text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_low: dict[str, list[tuple[str, str]]] = {}
        for term, rendering, low in shared.value:
            by_low.setdefault(low, []).append((term, rendering))
        automaton = ahocorasick.Automaton()
        for low in by_low:
            if low:
                automaton.add_word(low, low)
        automaton.make_automaton()
        for part in batches:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                places, rows = [], []
                for k, text in enumerate(some.column(1).to_pylist()):
                    found = set(word for _, word in automaton.iter(text)) if len(automaton) else set()
                    for low in found | ({""} & by_low.keys()):
                        rows += by_low[low]
                        places += [k] * len(by_low[low])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(places, pa.int64())), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                    names=["batch", "term", "rendering"],
                )

    return find


def cost(usage: DataFrame) -> DataFrame:
    """One row: tokens and price at 1 and 5 dollars a million (O-73)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return usage.agg(total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out")).withColumn("dollars", (F.col("tokens_in") + 5 * F.col("tokens_out")) / F.lit(1e6))
