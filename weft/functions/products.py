"""Words that tell products and treatments apart: pharmacy queries, routes, generic mentions, points for packs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null

# What an issue adds to a pharmacy query; all that match, in this order.
THERAPY = [
    (r"\b(hip|dysplasia|joint|arthritis|ortho\w*|patellar|luxation|stifle|osteo\w*)\b", "joint pain medication supplement"),
    (r"\b(pain|analges\w*|nsaid)\b", "pain medication"),
    (r"\b(obes\w*|weight|diet)\b", "obesity diet weight management"),
    (r"\b(tick|flea|parasit\w*|deworm\w*|worm)\b", "parasite control flea tick"),
    (r"\b(skin|dermat\w*|atop\w*|otitis|ear|itch\w*)\b", "dermatology medication"),
]
THERAPY_OTHERWISE = "medication treatment"
# Parts of a name and the route they stand for; the first that is found.
ROUTES = [(["inj", "injection"], "IM"), (["tab", "tablet", "capsule"], "PO"), (["syrup", "suspension"], "PO")]
# Words that by themselves name no product or service.
GENERIC_WORDS = [
    "examination", "exam", "test", "injection", "shot", "vaccine", "medicine",
    "medication", "drug", "tablet", "tablets", "capsule", "capsules", "pill",
    "pills", "liquid", "drops", "cream", "ointment", "spray", "powder",
    "syrup", "solution", "suspension", "inhaler", "patch", "suppository",
    "blood", "urine", "ultrasound", "scan", "imaging", "surgery",
    "procedure", "treatment", "therapy", "consultation", "checkup", "visit",
]
# Brands, strengths and procedures that make a single word specific.
SPECIFIC = [
    r"\b(cortex|coatex|nutrish|nutrich|simparica|simparico|bravecto|nexgard|heartgard|frontline|advantage|revolution|sentinel|interceptor|trifexis|comfortis|capstar|seresto|k9|advantix|vanguard|nobivac|felocell|purevax|rabvac|rabies|dhpp|dhlpp|fvr|fvrcp|felv|fiv|bordetella|lepto|lyme|anaplasma|ehrlichia|giardia|panleuk|calici|herpes|chlamydia|pneumonia|distemper|parvo|adenovirus|hepatitis|corona|parainfluenza|bordetella|kennel\s+cough)\b",
    r"\b\d+\s*(mg|ml|g|kg|lb|oz|tablets?|capsules?|pills?|doses?|vials?|bottles?|pack|packet|box|s|count)\b",
    r"\b\d+[sm]\b",
    r"\b(anal\s+gland|gland\s+expression|dental\s+cleaning|teeth\s+cleaning|spay|neuter|castration|ovariohysterectomy|declaw|microchip|ear\s+cleaning|nail\s+trim|grooming|bath|vaccination|deworming|flea\s+treatment|tick\s+treatment|heartworm\s+test|fecal\s+exam|urinalysis|blood\s+work|biopsy|surgery|suture|stitch|wound\s+care|bandage|splint|cast)\b",
]
# Brands and forms in the order they are looked for, and the pack that a brand is sold in by default.
SKU_BRANDS = ["coatex", "cortex", "nutrish", "nutrich", "maropitant", "simparica"]
SKU_FORMS = ["capsule", "capsules", "tablet", "tablets", "mg", "ml"]
SKU_PACKS = {"nutrish": "60", "nutrich": "60"}


def therapeutic_query(issue: Column) -> Column:
    """An issue with the words of every family of treatment it belongs to; blank for blank."""
    raw = F.trim(F.coalesce(issue, F.lit("")))
    found = F.array_compact(F.array(*(F.when(F.lower(raw).rlike(p), words) for p, words in THERAPY)))
    more = F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(THERAPY_OTHERWISE)
    return F.when(raw == "", "").otherwise(F.concat_ws(" ", raw, more))


def route_of(name: Column) -> Column:
    """The route that a product's name tells, empty if none."""
    low = F.lower(F.coalesce(name, F.lit("")))
    any_of = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(low, x))
    return F.coalesce(*(F.when(any_of(parts), route) for parts, route in ROUTES), F.lit(""))


def is_generic_mention(mention: Column) -> Column:
    """All words are generic (or there is none), or its only word names no brand, strength or procedure."""
    plain = F.trim(F.replace(F.lower(F.trim(F.coalesce(mention, F.lit("")))), F.lit("[unclear]"), F.lit("")))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    telling = F.array_except(words, F.array(*map(F.lit, GENERIC_WORDS)))
    specific = plain.rlike("|".join(SPECIFIC))
    return (F.size(telling) == 0) | ((F.size(words) == 1) & ~specific)


def sku_points(mention: Column, name: Column) -> Column:
    """Points of a product for a mention: its brand, form, number and default pack, as parts of the name.

    The mention's brand and form are the first of the list that it holds, its number the
    first run of digits.  A brand with a default pack and no number in the mention favours that pack.
    """
    q, n = (F.lower(F.coalesce(c, F.lit(""))) for c in (mention, name))
    first_of = lambda values: F.coalesce(*(F.when(F.contains(q, F.lit(v)), v) for v in values), F.lit(None).cast("string"))
    brand, form, number = first_of(SKU_BRANDS), first_of(SKU_FORMS), blank_to_null(F.regexp_extract(q, r"(\d+)", 1))
    pack = F.try_element_at(F.create_map(*(F.lit(x) for kv in SKU_PACKS.items() for x in kv)), brand)
    held = lambda part: F.coalesce(F.contains(n, part), F.lit(False))
    points = lambda c, v: F.when(c, v).otherwise(0.0)
    by_pack = F.when(number.isNull() & pack.isNotNull(), F.when(held(pack), 0.3).otherwise(-0.1)).otherwise(0.0)
    both = lambda a, b: F.contains(q, F.lit(a)) & F.contains(n, F.lit(b))
    total = points(held(brand), 0.2) + points(held(form), 0.15) + points(held(F.rtrim(form, F.lit("s"))), 0.15) + points(held(number), 0.2) + by_pack
    return F.round(total + points(both("capsule", "blister"), 0.05) + points(both("tablet", "tablet"), 0.05), 6)
