"""Is a text layer trustworthy? Counts by character class, metrics, a verdict, and the route of a page.

All are native expressions, but for the counts of a column of texts (see charcount). They come in steps (pieces, sorted_out, counts, metrics, verdict, route), each over the
struct that the step before gave, so that a regular expression runs once whether the steps are columns of a DataFrame
or are nested in transform() over an array of pages.

Null text counts as empty: zero counts, and a verdict of usable (nothing speaks against it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import charclass as cc
from leafmill.functions.charcount import counts_of
from leafmill.functions.fence import fence
from leafmill.schema import Thresholds

# Parts of the names of fonts whose text is known to be garbled, in lower case.
LEGACY_FONTS = ["krutidev", "kruti dev", "devlys", "chanakya", "walkman", "shivaji", "preeti", "shree-dev", "shreedev", "shree dev", "sutonnymj", "bamini", "aps-c-dv"]


def _only(text: Column, inside: str) -> Column:
    """How many characters of a class a text has: what stays when runs of all others go."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))


def squeezed(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, f"[{cc.SPACE}]+", "")


def pieces(text: Column) -> Column:
    """A struct of the text (null as empty), its characters that aren't blank, and what is neither Latin nor blank."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(t.alias("text"), F.length(squeezed(t)).alias("chars"), F.regexp_replace(t, f"[{cc.LATIN}{cc.SPACE}]+", "").alias("rest"))


def sorted_out(p: Column) -> Column:
    """pieces() with what of the rest isn't bad, and how much of that is Indic."""
    good = F.regexp_replace(p["rest"], f"[{cc.BAD}{cc.UNASSIGNED}]+", "")
    return F.struct(p["text"].alias("text"), p["chars"].alias("chars"), p["rest"].alias("rest"), good.alias("good"), _only(good, cc.INDIC).alias("indic"))


def counts(p: Column) -> Column:
    """A struct of counts from sorted_out(). Words and marks of Indic scripts are sought only where there are any."""
    rest, good = p["rest"], p["good"]
    # Words with all but Indic and foreign characters gone, a run of Indic ones as i, one of foreign ones as f.
    only = F.regexp_replace(F.regexp_replace(p["text"], f"[{cc.LATIN}]+", ""), f"[{cc.BAD}{cc.UNASSIGNED}{cc.ARABIC}{cc.COMMON}]+", "")
    short = F.regexp_replace(F.regexp_replace(only, f"[{cc.INDIC}]+", "i"), f"[^i{cc.SPACE}]+", "f")
    # Marks only matter beside other Indic characters.
    marks = F.regexp_replace(F.regexp_replace(p["text"], r"[\x{01}-\x{7E}]+", " "), f"[^{cc.INDIC}]+", " ")
    if_indic = lambda x: F.when(p["indic"] > 0, x).otherwise(F.lit(0))
    return F.struct(
        p["chars"].alias("chars"),
        p["indic"].alias("indic"),
        _only(good, cc.ARABIC).alias("arabic"),
        (p["chars"] - F.length(rest)).alias("latin"),
        (F.length(rest) - F.length(good)).alias("bad"),
        _only(rest, cc.PRIVATE).alias("private"),
        (F.length(rest) - F.length(F.replace(rest, F.lit(chr(cc.REPLACEMENT)), F.lit("")))).alias("replaced"),
        F.length(F.regexp_replace(good, f"[{cc.INDIC}{cc.ARABIC}{cc.COMMON}]+", "")).alias("foreign"),
        if_indic(F.regexp_count(marks, F.lit(f"(?<![{cc.BASE}])[{cc.MARK}]"))).alias("orphans"),
        if_indic(F.regexp_count(short, F.lit("f?i[if]*"))).alias("indic_words"),
        if_indic(F.regexp_count(short, F.lit("if[if]*|fi[if]*"))).alias("mixed"),
        F.length(squeezed(F.regexp_replace(p["text"], f"[^{cc.SPACE}]+", "x"))).alias("words"),
    )


def metrics(c: Column) -> Column:
    """A struct of the 13 metrics from counts(): percentages and means have one decimal, ties to even."""
    share = lambda name: F.when(c["chars"] > 0, F.bround(100.0 * c[name] / c["chars"], 1)).otherwise(F.lit(0.0))
    mean = F.when(c["words"] > 0, F.bround(c["chars"] / c["words"], 1)).otherwise(F.lit(0.0))
    return F.struct(
        c["chars"].alias("chars"),
        c["indic"].alias("indic_chars"),
        c["arabic"].alias("arabic_chars"),
        c["latin"].alias("latin_chars"),
        share("bad").alias("bad_pct"),
        share("private").alias("private_use_pct"),
        share("replaced").alias("replacement_pct"),
        share("foreign").alias("foreign_pct"),
        c["orphans"].alias("orphan_marks"),
        c["mixed"].alias("mixed_script_words"),
        c["indic_words"].alias("indic_words"),
        c["words"].alias("words"),
        mean.alias("mean_word_len"),
    )


def whole(x: Column) -> Column:
    """A number without decimals, ties to even, as text."""
    return F.bround(x, 0).cast("bigint").cast("string")


def tenth(x: Column) -> Column:
    """A number with one decimal as text: format_number() would put commas in."""
    return F.format_string("%.1f", x)


def legacy_fonts(fonts: Column) -> Column:
    """The distinct names that contain one of LEGACY_FONTS, sorted; of null there are none."""
    hit = lambda f: F.lower(f).rlike("|".join(LEGACY_FONTS))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(fonts, hit))), F.array().cast("array<string>"))


def _quoted(name: Column) -> Column:
    """In single quotes, or in double ones if it has single ones only."""
    plain = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    return F.when(name.contains("'") & ~name.contains('"'), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def verdict(m: Column, fonts: Column | None = None, t: Thresholds = Thresholds()) -> Column:
    """usable, reason and warnings of metrics(). Thresholds are held against the rounded percentages."""
    bad = m["bad_pct"] / 100 > t.max_bad
    private = bad & (m["private_use_pct"] >= m["replacement_pct"])
    replaced = bad & (m["replacement_pct"] / 100 > t.max_bad / 2)
    long_enough = (m["words"] >= 5) & ((m["indic_chars"] + m["latin_chars"]) / m["chars"] > 0.5)
    low, high = t.word_len_range
    old = legacy_fonts(fonts) if fonts is not None else None
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    problems = [
        F.when(private, say("private-use characters ", whole(m["private_use_pct"]), "%")),
        F.when(replaced, say("replacement characters U+FFFD ", whole(m["replacement_pct"]), "%")),
        F.when(bad & ~private & ~replaced, say("control or unassigned characters ", whole(m["bad_pct"]), "%")),
        F.when(m["foreign_pct"] / 100 > t.max_foreign, say("characters outside the supported scripts ", whole(m["foreign_pct"]), "%")),
        F.when((m["indic_chars"] > 0) & (m["orphan_marks"] >= t.min_orphans) & (m["orphan_marks"] / m["indic_chars"] > t.max_orphan_ratio), say(m["orphan_marks"].cast("string"), " combining marks detached from their base letter")),
        F.when((m["indic_words"] > 0) & (m["mixed_script_words"] >= t.min_mixed) & (m["mixed_script_words"] / m["indic_words"] > t.max_mixed_ratio), say(m["mixed_script_words"].cast("string"), " Indic words contain stray non-Indic letters")),
        F.when(long_enough & (m["mean_word_len"] > high), say("words implausibly long (mean ", tenth(m["mean_word_len"]), " characters)")),
        F.when(long_enough & (m["mean_word_len"] < low), say("words implausibly short (mean ", tenth(m["mean_word_len"]), " characters)")),
    ]
    if old is not None:
        problems.append(F.when(F.size(old) > 0, say("legacy Indic font ", F.array_join(F.transform(old, _quoted), ", "))))
    found = F.array_join(F.array_compact(F.array(*problems)), "; ")
    arabic = m["arabic_chars"] / F.greatest(m["chars"], F.lit(1)) > 0.3
    caveat = "Arabic-script text layer accepted without a structural check; if it reads reversed or disconnected, re-run with --force-ocr"
    return F.struct(
        (found == "").alias("usable"),
        F.when(found == "", F.lit("text layer passed validity check")).otherwise(say("text layer failed validity check (", found, ")")).alias("reason"),
        F.when(arabic, F.array(F.lit(caveat))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def route(chars: Column, cover: Column, paths: Column, v: Column, force: bool = False, t: Thresholds = Thresholds()) -> Column:
    """Whether a page goes to OCR, why, its warnings, and whether the verdict and the drawing paths had a say.

    chars: characters that aren't white space; cover: part of the page under images; paths: vector paths (asked for
    only where there is no text); v: the verdict. The first rule that fits decides. Nulls count as zero.
    """
    chars, cover, paths = (F.coalesce(x, F.lit(0)) for x in (chars, cover, paths))
    n, percent = chars.cast("string"), F.concat(whole(100 * cover), F.lit("%"))
    # (condition, to OCR, reason, rests on the verdict, rests on the paths)
    rules = [
        (F.lit(force), True, F.lit("OCR forced by --force-ocr"), False, False),
        ((chars == 0) & (cover >= t.min_image_cover), True, F.lit("no text layer"), False, False),
        ((chars == 0) & (paths >= t.drawing_paths), True, F.lit("no text layer (vector graphics only; the text may be outlined)"), False, True),
        (chars == 0, False, F.lit("blank page (no text, no images)"), False, True),
        ((chars < t.min_chars) & (cover >= t.min_image_cover), True, F.concat(F.lit("text layer too short ("), n, F.lit(" characters) and the page has image content")), False, False),
        (chars < t.min_chars, False, F.concat(F.lit("short text layer ("), n, F.lit(" characters), no images")), False, False),
        ((cover >= t.image_cover) & (chars < t.sparse_chars), True, F.concat(F.lit("text layer sparse ("), n, F.lit(" characters) and images cover "), percent, F.lit(" of the page")), False, False),
        (~v["usable"], True, v["reason"], True, False),
        (F.lit(True), False, F.concat(F.lit("text layer valid ("), n, F.lit(" characters)")), True, False),
    ]

    def pick(k: int) -> Column:
        out = None
        for rule in rules:
            value = rule[k] if isinstance(rule[k], Column) else F.lit(rule[k])
            out = F.when(rule[0], value) if out is None else out.when(rule[0], value)
        return out

    scanned = F.concat(F.lit("images cover "), percent, F.lit(" of this page; its text layer may be a scanner's own OCR, which passed the validity check but was not verified"))
    accepted = pick(3) & v["usable"]
    extra = F.when(cover >= t.image_cover, F.array(scanned)).otherwise(F.array().cast("array<string>"))
    return F.struct(
        pick(1).alias("ocr"),
        pick(2).alias("reason"),
        F.when(accepted, F.concat(v["warnings"], extra)).otherwise(F.array().cast("array<string>")).alias("warnings"),
        pick(3).alias("by_verdict"),
        pick(4).alias("by_paths"),
    )


def text_layer(chars: Column, cover: Column, paths: Column, m: Column, r: Column) -> Column:
    """The metrics behind a route, as schema.TEXT_LAYER: those that had no say are null."""
    judged = lambda x: F.when(r["by_verdict"], x)
    rest = "indic_chars arabic_chars latin_chars bad_pct private_use_pct replacement_pct foreign_pct orphan_marks mixed_script_words indic_words words mean_word_len".split()
    return F.struct(
        chars.cast("int").alias("chars"),
        F.bround(100 * F.coalesce(cover, F.lit(0.0)), 0).cast("int").alias("image_cover_pct"),
        F.when(r["by_paths"], F.coalesce(paths, F.lit(0))).cast("int").alias("drawing_paths"),
        *(judged(m[c]).alias(c) for c in rest),
    )


def _measured(df: DataFrame, text: Column, into: str) -> DataFrame:
    """With metrics() of a text, whose counts come from one look at each character instead of counts()."""
    out = df.withColumn("__c", fence(counts_of(text)))
    return out.withColumn(into, fence(metrics(F.col("__c")))).drop("__c")


def with_metrics(df: DataFrame, text: str = "text", into: str = "metrics") -> DataFrame:
    """The DataFrame with a struct column of metrics()."""
    return _measured(df, F.col(text), into)


def with_route(df: DataFrame, text: Column, cover: Column, paths: Column, fonts: Column | None = None, force: bool = False, t: Thresholds = Thresholds()) -> DataFrame:
    """The DataFrame with struct columns `metrics`, `verdict` and `route`."""
    out = _measured(df, text, "metrics").withColumn("verdict", fence(verdict(F.col("metrics"), fonts, t)))
    return out.withColumn("route", route(F.col("metrics.chars"), cover, paths, F.col("verdict"), force, t))
