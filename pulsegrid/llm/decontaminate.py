"""Benchmark decontamination by template windows, DataFrame functions only.

Words become a template: numbers, units after them and names (capitalised words
inside a sentence) turn into typed placeholders, everything else is lowered and
stripped of outer punctuation. Windows of ``k`` template words are hashed on
both sides and joined by hash, so a question with other numbers or names still
meets its original. For every alignment of a text with an item the slots are
then checked: equal originals must have equal replacements. Windows of mostly
placeholders say too little as templates: they meet word for word. A text is reported
for an item if consistent alignments cover enough of the item's windows.

The documents' windows are made, hashed and looked up in one generated loop.
The benchmark's windows are broadcast only up to ``BROADCAST_WINDOWS``; beyond
that both sides are shuffled by hash.

An item's first word has no word before it, so in documents a window whose first
word is a name or unit only by the word before it is hashed a second time without
that word's placeholder; it meets first windows only, and counts only for pairs
that are not found without it. Items with fewer than ``k``
words are looked for at every word, as windows of their own length; if more than
half of such a window is placeholders, word for word.

Results: rows exist only for contaminated pairs. An item or text with fewer than
``k`` words has one window, the whole of it. Null or empty texts and items match
nothing. Rows that share an id count as one document; rows with a null id are
left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a window, share of an item's windows that must be covered, most placeholders in a window that meets as a template, and most windows that are broadcast.
WINDOW, COVERED, MOST_SLOTS, BROADCAST_WINDOWS = 8, 0.5, 4, 50_000

PLACEHOLDERS = "'<n>', '<u>', '<p>'"

#: Units as fixed values, written after a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds lb lbs "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes min hour hours h day days week weeks month months year years "
    "percent degree degrees dollar dollars cent cents euro euros kmh mph km/h m/s hz khz mhz ghz w kw v a j kj cal kcal pa kpa bar k c f"
).split()


def _templates(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``words`` as written, ``literal`` (lowered) and ``template``: all of the same length."""
    rows = rows.select(*keep, F.expr(f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')").alias("words"))
    core = r"regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}%]+$', '')"
    rows = rows.select(*keep, "words", F.expr(f"transform(words, x -> {core})").alias("core"))
    number = r"x rlike '^[0-9][0-9.,:/]*%?$'"
    before = r"get(core, i - 1) rlike '^[0-9][0-9.,:/]*$'"
    units = ", ".join(f"'{u}'" for u in UNITS)
    name = r"i > 0 and x rlike '^\\p{Lu}' and not (get(words, i - 1) rlike '[.!?:;]\\W*$')"
    return rows.select(*keep, "words", F.expr("transform(core, x -> lower(x))").alias("literal"), F.expr(f"transform(core, (x, i) -> case when {number} then '<n>' when i > 0 and {before} and lower(x) in ({units}) then '<u>' when {name} then '<p>' else lower(x) end)").alias("template"))


def _hashed(rows: DataFrame, keep: list[str], k: int, literal: bool, short: list[int] | None = None) -> DataFrame:
    """A row for each window: ``at``, ``variant``, ``window``. With ``literal``, windows of more than MOST_SLOTS placeholders hash their words.

    Variant 0 is the window as it stands. Items (no ``short``) of fewer than k words have their whole once more as variant 1.
    Documents have variant 1 for a window whose first word stands as at the start of a text, and from 2 on windows of
    the lengths in ``short``, null where there is none.

    No filter may stand on the arrays: it would be pushed below them with all that makes them in it.
    ``explode_outer`` keeps Spark from adding one; a text without words gives one window that no item has.
    """
    words = literal or short is None or bool(short)
    slot = f"transform(template, x -> if(x in ({PLACEHOLDERS}), 1, 0))"
    hashes = [F.expr("transform(template, x -> xxhash64(x))").alias("h"), F.expr("transform(zip_with(template, literal, (x, y) -> if(x in ('<u>', '<p>'), y, null)), x -> if(x is null, null, xxhash64(x)))").alias("f")]
    if words:
        hashes += [F.expr("transform(literal, x -> xxhash64(x))").alias("v"), F.expr(slot).alias("s")]
    rows = rows.select(*keep, *hashes)
    rows = rows.select(*keep, "h", "f", *(["v", "s"] if words else []), F.explode_outer(F.expr(f"sequence(0, greatest(size(h) - {k if not short else min(short)}, 0))")).alias("at"))

    def part(x: str, n: int, first: str | None = None) -> str:
        return ", ".join(([first] if first else [f"get({x}, at)"]) + [f"get({x}, at + {j})" for j in range(1, n)])

    def held(n: int, first: str = "coalesce(get(s, at), 0)") -> str:
        return " + ".join([first] + [f"coalesce(get(s, at + {j}), 0)" for j in range(1, n)])

    def window(first: str | None, count: str) -> str:
        made = f"xxhash64({part('h', k, first)})"
        return f"if({count} > {MOST_SLOTS}, xxhash64(1, {part('v', k)}), {made})" if literal else made

    def own(n: int, size: str) -> str:
        # the first word stands as at the start of a text
        first, count = "coalesce(get(f, at), get(h, at))", held(n, "if(get(f, at) is null, coalesce(get(s, at), 0), 0)")
        return f"if(2 * ({count}) > {size}, xxhash64(3, {part('v', n)}), xxhash64(2, {part('h', n, first)}))"

    usual = window(None, held(k) if literal else "")
    if short is None:
        variants = [usual, f"if(size(h) < {k}, {own(k, 'size(h)')}, null)"]
    else:
        # a text of fewer than k words has its whole as the one usual window
        usual = f"if(at <= greatest(size(h) - {k}, 0), {usual}, null)" if short else usual
        begun = window("get(f, at)", held(k, "0") if literal else "")
        variants = [usual, f"if(get(f, at) is not null and at <= size(h) - {k}, {begun}, null)", *(f"if(at <= size(h) - {n}, {own(n, str(n))}, null)" for n in short)]
    return rows.select(*keep, "at", F.posexplode_outer(F.expr(f"array({', '.join(variants)})")).alias("variant", "window"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, coverage, n_windows, reworded): documents that hold benchmark items, word for word or re-parameterised."""
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    b = items.where(F.col(item_id).isNotNull() & F.col(item_text).cast("string").rlike(r"[^\x20\x09-\x0D]")).select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))

    b = _templates(b, ["item_id"], "text")
    slots = lambda kind, last: f"filter(transform(sequence(0, {last}), j -> struct({kind} as kind, get(words, at + j) as value)), s -> s.kind in ({PLACEHOLDERS}))"
    windows = _hashed(b, ["item_id", "words", "template"], k, True).where("window is not null")
    windows = windows.select("item_id", F.col("at").alias("item_at"), "window", F.expr(slots("get(template, at + j)", k - 1)).alias("item_slots"), F.expr("if(variant = 1, size(template), null)").alias("own"))
    windows = windows.withColumn("n_windows", F.expr("1"))
    sizes = windows.groupBy("item_id").agg(F.count_distinct("item_at").alias("n_windows"))
    windows = windows.drop("n_windows")
    # without such windows on the items' side those of the documents meet nothing in either form
    literal = not windows.where(f"size(item_slots) > {MOST_SLOTS}").isEmpty()
    short = sorted(r["own"] for r in windows.where("own is not null").select("own").distinct().collect())
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS

    t = _templates(d, ["doc_id"], "text")
    made = _hashed(t, ["doc_id", "words", "template"], k, literal, short)
    met = made.join(F.broadcast(windows) if few else windows, "window").where("variant != 1 or item_at = 0")
    # a document's slots are read off only where a window met
    plain = lambda x: f"regexp_replace({x}.value, '[^\\\\p{{L}}\\\\p{{N}}]', '')"
    same = f"transform(item_slots, x -> struct(x.kind as kind, {plain('x')} as item, {plain('x')} as doc))"
    # the words of a window that begins as at the start of a text, and of one as long as its item
    kind = "if(j = 0 and variant > 0 and get(template, at) != '<n>', '', get(template, at + j))"
    other = f"zip_with(item_slots, {slots(kind, f'coalesce(own, {k}) - 1')}, (x, y) -> struct(x.kind as kind, {plain('x')} as item, {plain('y')} as doc))"
    # usual windows are judged alone and together with the added ones: these decide only where the usual ones fall short
    met = met.select("doc_id", "item_id", "item_at", F.explode(F.expr("if(variant = 0, array(true, false), array(false))")).alias("usual"), (F.col("at") - F.col("item_at")).alias("shift"), F.expr(f"if(size(item_slots) > {MOST_SLOTS} or 2 * size(item_slots) > own, {same}, {other})").alias("slots"))
    aligned = met.groupBy("doc_id", "item_id", "usual", "shift").agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    # every original has one replacement
    aligned = aligned.where(F.expr("size(array_distinct(transform(slots, s -> struct(s.kind, s.item)))) = size(slots)"))
    aligned = aligned.select("doc_id", "item_id", "usual", F.explode("places").alias("place"), F.expr("exists(slots, s -> s.item != s.doc)").alias("reworded"))
    found = aligned.groupBy("doc_id", "item_id", "usual", "place").agg(F.min("reworded").alias("reworded")).groupBy("doc_id", "item_id", "usual").agg(F.count("*").alias("n"), F.max("reworded").alias("reworded"))
    coverage = F.col("n") / F.col("n_windows")
    found = found.join(sizes, "item_id").where(coverage >= covered).select("doc_id", "item_id", "usual", F.struct(coverage.alias("coverage"), F.col("n").alias("n_windows"), "reworded").alias("told"))
    return found.groupBy("doc_id", "item_id").agg(F.max_by("told", "usual").alias("told")).select("doc_id", "item_id", "told.*")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
