"""Which reminders ask for something to be done, in texts, rows and numbered notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null

# Patterns of reminder texts, matched without regard to case.
ACTIONABLE = (
    r"\b("
    r"recheck|re-check|follow[- ]?up|followup|return visit|callback|call back|"
    r"schedule|book|appointment|vaccin|booster|surgery|suture removal|"
    r"recall|next visit|in \d+ (day|week|month)|after \d+ (day|week|month)|"
    r"next month|next week|tomorrow|asap|due date|lab (test|work)|x-?ray|"
    r"ultrasound|cbc|blood test|reculture|re-culture|physio|hydrotherapy"
    r")\b"
)
PASSIVE = (
    r"\b("
    r"if (symptoms )?worsen|if needed|as needed|watch|monitor|observe|"
    r"keep an eye|contact (us )?if|call (us )?if|return if|unless|"
    r"should (symptoms|signs)|appetite|water intake|activity level"
    r")\b"
)
AVOID = r"\b(avoid|do not|don't|should be avoided|must not|refrain from)\b"
CUES = r"\b(recheck|schedule|book|appointment|vaccin|in \d+|next (week|month|visit))\b"
# Intents that always ask for something, and a due date that is none.
SET_INTENTS = ["Scheduled", "Future"]
NO_DATE = "ASAP"


def found(c: Column, pattern: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + pattern)


def only_warns(c: Column) -> Column:
    """A warning without anything to schedule."""
    return found(c, AVOID) & ~found(c, CUES)


def is_actionable(c: Column) -> Column:
    """A text that names an action; not if it only warns, nor if it is passive or conditional without anything to schedule."""
    return ~only_warns(c) & found(c, ACTIONABLE) & (~found(c, PASSIVE) | found(c, CUES))


def row_text(item_name: Column, name: Column, remarks: Column, due: Column) -> Column:
    return F.trim(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (item_name, name, remarks, due))))


def needs_action(item_name: Column, name: Column, remarks: Column, due: Column, intent: Column, item_id: Column) -> Column:
    """A reminder row that asks for something: by its intent, a due date, an id of digits, or its joined text; warnings alone never do."""
    whole = row_text(item_name, name, remarks, due)
    dated = F.upper(blank_to_null(due)) != NO_DATE
    numbered = F.replace(item_id, F.lit("-"), F.lit("")).rlike("^[0-9]+$")
    by = F.trim(intent).isin(SET_INTENTS)
    return ~only_warns(whole) & (F.coalesce(by, F.lit(False)) | F.coalesce(dated, F.lit(False)) | F.coalesce(numbered, F.lit(False)) | is_actionable(whole))


def lines_of(c: Column) -> Column:
    """The lines of a numbered list without their numbers; a text of numbers alone is one line."""
    raw = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    lines = F.transform(F.split(raw, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^\d+[.)]\s*", ""))
    kept = F.filter(lines, lambda x: x != "")
    return F.when((F.size(kept) == 0) & (raw != ""), F.array(raw)).otherwise(kept)


def actionable_lines(c: Column) -> Column:
    """struct<text, hidden>: the lines that ask for something, numbered anew, and how many were left out."""
    lines = lines_of(c)
    kept = F.filter(lines, is_actionable)
    text = F.array_join(F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.struct(text.alias("text"), (F.size(lines) - F.size(kept)).alias("hidden"))
