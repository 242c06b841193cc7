"""Rule packs: named predicates in order, of which the first that holds is the reason for a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import strip

# Fixed values.  CJK: the ideographs; with kana for the guardrails.  EMOJI: characters of emoji-only texts.
CJK = r"[一-鿿㐀-䶿]"
CJK_KANA = r"[一-鿿぀-ゟ゠-ヿ]"
EMOJI = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}"
    r"\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}\x{200D}\x{2640}\x{2642}\x{231A}-\x{231B}"
)
# What a text that declines says, in the languages of the logs.
REFUSALS = (
    "извини", r"i\s+cannot", r"i'?m\s+sorry", r"как\s+ии", r"как\s+(?:языковая|ai|искусственный)",
    r"language\s+model", r"i'?m\s+(?:an?|just)\s+a",
)
REFUSAL = f"(?iuU)({'|'.join(REFUSALS)})"
REFUSAL_GUARD = r"(?iu)(i can'?t|cannot help|unable to|as an ai|i am not able)"
FILLER = r"[ㅤᅟᅠ⠀]{3,}"
SAME_DIGIT = r"\A(\d)\1{6,}$"
COMMAND = r"(?U)\A/\w"


@dataclass(frozen=True)
class Rule:
    reason: str
    holds: Callable[[Column], Column]


@dataclass(frozen=True)
class RulePack:
    """Rules over one text column, in order."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def reason(self, c: Column) -> Column:
        """The first reason that holds, else null."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(rule.holds(c), F.lit(rule.reason)).otherwise(out)
        return out


def matches(pattern: str) -> Callable[[Column], Column]:
    return lambda c: c.rlike(pattern)


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds, else null; a null condition does not hold."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def template_percent(phrase: str) -> str:
    """The pattern of a template message: phrase with {n} for a whole number of per cent."""
    return r"(?iu)" + phrase.replace("{n}", r"\d+")


def leak_patterns(templates: tuple[str, ...] = (), commands: tuple[str, ...] = ()) -> list[str]:
    """Patterns of messages that bots leave under many senders: templates and commands are configuration."""
    return [*map(template_percent, templates), *(rf"(?U)\A/{c}\b" for c in commands), FILLER, SAME_DIGIT]


def is_quality_response(c: Column) -> Column:
    """3 to 300 characters, not only emoji, not a command."""
    return F.length(c).between(3, 300) & ~c.rlike(rf"(?U)\A[\s{EMOJI}]+$") & ~c.rlike(COMMAND)


def post_filter(spam: str | None = None, profanity: str | None = None, refusal: str = REFUSAL) -> RulePack:
    """Why a generated text is rejected: empty, too short, too long, wrong script, spam, refusal, and, where a
    profanity pattern is given, none of it."""
    rules = [
        Rule("empty", lambda c: F.coalesce(c, F.lit("")) == ""),
        Rule("too_short", lambda c: F.length(c) < 5),
        Rule("too_long", lambda c: F.length(c) > 500),
        Rule("cjk", matches(CJK)),
    ]
    if spam:
        rules.append(Rule("spam", matches(spam)))
    rules.append(Rule("refusal", matches(refusal)))
    if profanity:
        rules.append(Rule("no_profanity", lambda c: ~c.rlike(profanity)))
    return RulePack(tuple(rules))


def augment_reason(chosen: Column, poison: Column, spam: str) -> Column:
    """Why a pair does not become a training example, but for duplicates."""
    return first_reason((F.length(chosen) < 5, "too_short"), (F.length(chosen) > 500, "too_long"), (chosen.rlike(CJK), "cjk"), (chosen.rlike(spam), "spam"), (poison, "poison"))


def any_message(messages: Column, pattern: str) -> Column:
    return F.exists(messages, lambda m: F.coalesce(m["content"].rlike(pattern), F.lit(False)))


def any_assistant(messages: Column, pattern: str) -> Column:
    return F.exists(messages, lambda m: (m["role"] == "assistant") & F.coalesce(m["content"].rlike(pattern), F.lit(False)))


def artifact_flags(c: Column, identity: str) -> dict[str, Column]:
    """Signs of a careless generation; `identity` is the pattern of bots naming themselves."""
    return {
        "speaker_prefix": c.rlike(r"(?U)\A[А-ЯA-ZЁ][^:\n]{1,40}:\s+"),
        "bot_identity": c.rlike(identity),
        "markdown": F.contains(c, F.lit("```")) | F.contains(c, F.lit("**")) | c.rlike(r"(?mU)^\s*[-*]\s+"),
        "emoji": c.rlike(r"[\x{1F300}-\x{1FAFF}]"),
        "too_short": F.length(strip(c)) < 5,
        "too_long_300": F.length(c) > 300,
    }


def chat_filter(records: DataFrame, bots: list[str], mentions: list[str], leaks: list[str], names: list[str] | None = None) -> DataFrame:
    """Records (id, from, text, reply_to, ...) that people wrote to people: not blank, not a bot's, without
    mentions (substrings, any case), without leaked bot messages, not a reply to a bot; with `names`
    (patterns), without a bot named either.  Replies are told by an anti join on the bots' message ids."""
    text = F.col("text")
    kept = records.where((strip(text) != "") & ~F.coalesce(F.col("from").isin(bots), F.lit(False)))
    for m in mentions:
        kept = kept.where(~F.contains(F.lower(text), F.lit(m)))
    for pattern in [*leaks, *(f"(?iuU){n}" for n in names or [])]:
        kept = kept.where(~text.rlike(pattern))
    theirs = records.where(F.col("from").isin(bots)).select(F.col("id").alias("__bot_message")).distinct()
    return kept.join(theirs, kept["reply_to"] == theirs["__bot_message"], "left_anti")


def before_first(records: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records strictly before the first ts of `marks`, and the others; with no mark all are before."""
    cut = marks.agg(F.min("ts").alias("__cut"))  # one row, so broadcasting it is bounded
    joined = records.join(F.broadcast(cut))
    early = F.coalesce(F.col("ts") < F.col("__cut"), F.lit(True))
    return joined.where(early).drop("__cut"), joined.where(~early).drop("__cut")


def glob_pattern(glob: str) -> str:
    """A path pattern as a regular expression; * crosses folders too."""
    out = ""
    for ch in glob:
        out += ".*" if ch == "*" else "." if ch == "?" else ch if ch.isalnum() or ch in "_/-" else "\\" + ch
    return rf"(?s)\A{out}\z"


def matching_paths(paths: DataFrame, globs: list[str]) -> DataFrame:
    return paths.where(F.col("path").rlike("|".join(map(glob_pattern, globs)) or r"(?!)")).orderBy("path")
