"""Text expressions. Unicode classes are asked for explicitly: Java's default ones are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of chats and their shorthand.
SHORTHAND = {"please": "pls", "what's": "whats", "what is": "whats", "hours": "hrs", "you": "u", "thanks": "thx", "are": "r", "because": "bc", "tomorrow": "tmrw"}
#: Words that mark chat style.
SLANG = ("pls", "plz", "whats", "aight", "hrs", "thx", "u", "ur", "lol", "haha", "gonna", "wanna", "asap", "btw", "idk", "rn")
#: Prefixes of entity ids and the class each one hints at.
PREFIX_CLASS = {"APT": "appointment_manager", "PO": "orders", "DOC": "document_processing", "TR": "yard_management", "LD": "shipment_information.realtime_query"}
#: The pattern of an entity id, a known prefix and digits with no letter before and no digit after.
ENTITY_ID = rf"(?<![A-Za-z])({'|'.join(PREFIX_CLASS)})-(\d+)(?!\d)"
#: The pattern of a hint of how long to wait in an error message.
RETRY_DELAY = r"(?i)retry(?:Delay)?['\"]?[:\s]+['\"]?(\d+(?:\.\d+)?)s"
#: Script ranges that rule out a Latin-script language.
NON_LATIN = "[\u0600-\u06ff\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af\u0400-\u04ff]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends (``trim`` knows the space only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def n_words(text: Column) -> Column:
    """White-space separated words; 0 for blank texts."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def n_alpha_words(text: Column) -> Column:
    """Runs of two letters or more, in any script."""
    return F.regexp_count(text, F.lit(r"(?U)[^\W\d_]{2,}"))


def collapse(text: Column) -> Column:
    """Lower case, every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def windows(words: Column, width: int) -> Column:
    """All runs of ``width`` words as strings; none if there are fewer words.

    ``words`` is bound to a variable: inside the inner function it would be
    computed anew for every run.
    """

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - width + 1)
        return F.when(F.size(w) >= width, F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(width)), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(words), runs))


def words_of(text: Column) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def parent(label: Column) -> Column:
    """Upper level of a dotted label."""
    return F.split_part(label, F.lit("."), F.lit(1))


def entity_prefix(text: Column) -> Column:
    return F.regexp_extract(text, ENTITY_ID, 1)


def entity_number(text: Column) -> Column:
    return F.regexp_extract(text, ENTITY_ID, 2)


def swap_prefix(text: Column, prefix: Column) -> Column:
    """Every entity id with ``prefix`` in place of its own; digits and the rest stay."""
    return F.regexp_replace(text, F.lit(ENTITY_ID), F.concat(prefix, F.lit("-$2")))


def has_slang(text: Column) -> Column:
    return text.rlike(rf"(?iU)\b(?:{'|'.join(SLANG)})\b")


def chat_style(text: Column) -> Column:
    """Lower case, shorthand, no ``.,!?``."""
    out = F.lower(text)
    for word, short in SHORTHAND.items():
        out = F.regexp_replace(out, rf"\b{word}\b", short)
    return F.regexp_replace(out, r"[.,!?]", "")


def post_rule_lang(text: Column, lang: Column, confidence: Column) -> Column:
    """``und`` for texts of under two words in Latin script; a doubtful Latin-script guess is ``en``."""
    latin = ~text.rlike(NON_LATIN)
    return F.when(latin & (n_alpha_words(text) < 2), "und").when(latin & (lang != "en") & (confidence < 0.35), "en").otherwise(lang)


def guessed_lang(text: Column) -> Column:
    """Language by its letters alone, first match wins."""
    return F.when(text.rlike("[äöüß]"), "de").when(text.rlike("[ñíóúá]"), "es").when(text.rlike("[çèêéâ]"), "fr").otherwise("en")


def without_prefix(text: Column, prefix: str) -> Column:
    """Without ``prefix``, where it has one."""
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def last_part(text: Column, separator: str) -> Column:
    """What follows the last ``separator``; the whole text without one."""
    return F.split_part(text, F.lit(separator), F.lit(-1))


def override(key: Column, values: dict, usual: Column) -> Column:
    """The value that ``values`` has for ``key``, else ``usual``."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, key), usual)


def retry_delay(message: Column, attempt: Column, most: int = 60) -> Column:
    """Seconds to wait: what the message asks for and one more, else twice as long with every attempt."""
    asked = F.regexp_extract(message, RETRY_DELAY, 1)
    return F.when(asked != "", asked.cast("double") + 1).otherwise(F.least(F.lit(float(most)), F.pow(F.lit(2.0), attempt)))


def shots_prompt(intro: list[str], names: list[str], about: list[Column], unknown: str | None, shots: Column, outro: str) -> Column:
    """A prompt as of a classifier: intro, a line for each name, one for ``unknown`` where the set is open, examples (an array of lines), outro.

    Parts that are absent (no ``unknown``, an empty or null array) leave no line behind.
    """
    listed = [F.format_string("- %s: %s", F.lit(n), a) for n, a in zip(names, about, strict=True)]
    open_ = [F.lit(f"- unknown: {unknown}")] if unknown else []
    examples = F.when(F.size(F.coalesce(shots, F.array().cast("array<string>"))) > 0, F.concat(F.array(F.lit(""), F.lit("Examples:")), shots)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(*[F.lit(x) for x in intro], F.lit(""), F.lit("Labels:"), *listed, *open_), examples, F.array(F.lit(""), F.lit(outro)))
    return F.array_join(lines, "\n")


def prompt(intro: str, names: list[str], about: list[Column], outro: str) -> Column:
    """A prompt of fixed lines around one line for each name, ``- name: about``."""
    lines = [F.format_string("- %s: %s", F.lit(n), a) for n, a in zip(names, about, strict=True)]
    return F.concat_ws("\n", F.lit(intro), F.lit(""), *lines, F.lit(""), F.lit(outro))


def json_number(document: Column, path: str, usual: float) -> Column:
    """A number inside a JSON text; ``usual`` if it is absent or no number."""
    return F.coalesce(F.get_json_object(document, path).try_cast("double"), F.lit(usual))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(value * 100, digits), F.lit("%"))
