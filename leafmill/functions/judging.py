"""Grades of a judge: the JSON in its reply, the figures of a page, and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.metrics import cer_of, wer_of
from leafmill.functions.text import normalize

VERDICTS = ["good", "acceptable", "poor"]
#: What a reply holds; wrong_text is read as text first, as entries that aren't objects are dropped.
REPLY = "struct<transcription:string,score:double,verdict:string,reading_order_ok:boolean,missing_text:array<string>,wrong_text:array<string>,hallucinated_text:array<string>,notes:string>"

PROMPT = """The picture is one page of a scanned document; the text below it was read off by machine.

First write down all text on the page as it is printed: same script, same spelling, in reading order. Don't look at the machine's text for this.
Then grade the machine's text against the page.

Answer with one JSON object and nothing else:
{"transcription": "<text of the page>",
 "score": <1 to 10>,
 "verdict": "good" | "acceptable" | "poor",
 "reading_order_ok": <true or false>,
 "missing_text": ["<what the machine left out>"],
 "wrong_text": [{"ocr": "<machine's text>", "actual": "<text on the page>"}],
 "hallucinated_text": ["<what isn't on the page>"],
 "notes": "<a sentence or two>"}
Give at most 10 entries in missing_text and in wrong_text.

Machine's text:
<<<
__OCR__
>>>"""


def prompt(text: Column) -> Column:
    """The prompt with a page's text put in."""
    return F.replace(F.lit(PROMPT), F.lit("__OCR__"), F.coalesce(text, F.lit("")))


def json_part(reply: Column) -> Column:
    """From the first brace to the last; null if there are none."""
    found = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def parsed(reply: Column) -> Column:
    """The reply as a struct by REPLY; null if it has no JSON object or one that can't be read."""
    part = json_part(reply)
    return F.when(F.try_parse_json(part).isNotNull(), F.from_json(part, REPLY, {"mode": "PERMISSIVE"}))


def percent(error_rate: Column) -> Column:
    """100 less an error rate in percent, from 0 to 100, with two decimals."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - error_rate))), 2)


def misread(wrong: Column) -> Column:
    """Entries that are objects, with plainer names."""
    objects = F.filter(wrong, lambda w: F.ltrim(w).startswith("{"))
    return F.transform(objects, lambda w: F.struct(F.get_json_object(w, "$.ocr").alias("ocr_text_says"), F.get_json_object(w, "$.actual").alias("page_actually_says")))


def page_figures(reply: Column, text: Column) -> dict[str, Column]:
    """Columns of a judged page from its parsed reply and its OCR text. Missing lists are empty, missing texts empty, other missing values null."""
    none = F.array().cast("array<string>")
    said = normalize(reply["transcription"])
    read = normalize(text)
    c, w = cer_of(said, read), wer_of(said, read)
    return {
        "llm_quality_rating_out_of_10": reply["score"],
        "llm_verdict": reply["verdict"],
        "reading_order_correct": reply["reading_order_ok"],
        "character_accuracy_percent": percent(c),
        "word_accuracy_percent": percent(w),
        "character_error_rate_percent": F.bround(100 * c, 2),
        "word_error_rate_percent": F.bround(100 * w, 2),
        "text_on_page_missing_from_ocr": F.coalesce(reply["missing_text"], none),
        "misread_text": F.coalesce(misread(reply["wrong_text"]), F.array().cast("array<struct<ocr_text_says:string,page_actually_says:string>>")),
        "text_in_ocr_but_not_on_page": F.coalesce(reply["hallucinated_text"], none),
        "llm_judge_comments": F.coalesce(reply["notes"], F.lit("")),
        "llm_transcription": F.coalesce(reply["transcription"], F.lit("")),
    }


def summary() -> list[Column]:
    """Aggregates over judged pages. Averages skip pages without the value."""
    mean = lambda c: F.bround(F.avg(c), 2).alias(f"average_{c}")
    return [
        *(mean(c) for c in ("llm_quality_rating_out_of_10", "character_accuracy_percent", "word_accuracy_percent", "character_error_rate_percent", "word_error_rate_percent")),
        *(F.count_if(F.col("llm_verdict") == v).alias(f"number_of_pages_{v}") for v in VERDICTS),
        F.count_if(~F.col("reading_order_correct")).alias("number_of_pages_with_wrong_reading_order"),
        F.sum("llm_input_tokens").alias("total_llm_input_tokens"),
        F.sum("llm_output_tokens").alias("total_llm_output_tokens"),
        F.bround(F.sum("llm_call_latency_seconds"), 2).alias("total_llm_call_latency_seconds"),
        mean("llm_call_latency_seconds"),
        F.count(F.lit(1)).alias("number_of_pages_judged"),
    ]
