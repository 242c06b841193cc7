"""Text functions as Column builders.  Regular expressions are Java's with (?U), so \\s, \\w and \\d are Unicode
classes and (?iu) folds every script, as in Python's `re`; lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"(?U)\A{_WS}+|{_WS}+\z", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){_WS}+", " "))


def flatten_variant(v: Column) -> Column:
    """The text of a VARIANT that is a string, or a list of strings and {text: string}; else ''."""
    kind = F.schema_of_variant(v)
    parts = F.try_variant_get(v, "$", "array<variant>")
    one = F.transform(
        parts,
        lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))
        .when(F.schema_of_variant(p).startswith("OBJECT"), F.try_variant_get(p, "$.text", "string"))
        .otherwise(""),
    )
    joined = F.array_join(F.transform(one, lambda x: F.coalesce(x, F.lit(""))), "")
    return F.coalesce(F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), joined), F.lit(""))


def normalize(c: Column) -> Column:
    """A template of a text: numbers as D, then links and mentions as @, white space collapsed, lower case."""
    numbers = F.regexp_replace(c, r"(?U)\d+(?:[.,]\d+)?", "D")
    links = F.regexp_replace(numbers, r"(?U)https?://\S+|t\.me/\S+|@\w+", "@")
    return F.lower(collapse(links))


def turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>"))


def render_chat(messages: Column) -> Column:
    """messages (array of {role, content}) in chat markup, joined by line breaks."""
    return F.array_join(F.transform(messages, lambda m: turn(m["role"], m["content"])), "\n")


def render_chat_lines(messages: Column) -> Column:
    """The variant that ends every message with a line break."""
    return F.array_join(F.transform(messages, lambda m: F.concat(turn(m["role"], m["content"]), F.lit("\n"))), "")


def serialize(context: Column, response: Column, context_type) -> Column:
    """A prompt and its response in chat markup: a list of strings is one user turn, a list of messages is
    itself."""
    if context_type == ArrayType(StringType()):
        head = turn(F.lit("user"), F.array_join(context, "\n"))
    else:
        head = render_chat(context)
    return F.concat_ws("\n", F.when(head != "", head), turn(F.lit("assistant"), response))


def render_folded_system(system: Column, lines: Column) -> Column:
    """The template without a system role: the system prompt opens the user's turn."""
    return F.concat(F.lit("<start_of_turn>user\n"), system, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("<end_of_turn>\n<start_of_turn>model\n"))


def render_request(system: Column, messages: Column) -> Column:
    """Messages {role, name, content} as a server renders them: its own system prompt, callers' system messages
    left out, named user turns prefixed, an open assistant turn at the end."""

    def one(m: Column) -> Column:
        named = (m["role"] == "user") & (F.coalesce(m["name"], F.lit("")) != "")
        return turn(m["role"], F.when(named, F.concat(strip(m["name"]), F.lit(": "), strip(m["content"]))).otherwise(strip(m["content"])))

    said = F.transform(F.filter(messages, lambda m: m["role"] != "system"), one)
    return F.array_join(F.concat(F.array(turn(F.lit("system"), system)), said, F.array(F.lit("<|im_start|>assistant\n"))), "\n")


def _without_markup(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?sU)<think>.*?</think>\s*", "")
    c = F.regexp_replace(c, r"(?s)<\|im_start\|>.*", "")
    return F.regexp_replace(c, r"<\|im_end\|>", "")


def strip_tokens(c: Column) -> Column:
    """A response without chat markup, thoughts and a leading <bot>."""
    return strip(F.regexp_replace(strip(_without_markup(c)), r"(?U)\A<bot>\s*", ""))


def clean_response(c: Column, names: tuple[str, ...] = ("bot", "name")) -> Column:
    """As strip_tokens, and without one leading `name:` of those given, in any case."""
    heads = "|".join(["<bot>", *(f"{n}:" for n in names)])
    return strip(F.regexp_replace(_without_markup(c), rf"(?iuU)\A\s*(?:{heads})\s*", ""))


#: Prefixes in the order in which they are removed; the first names bots and is configuration.
def prefix_rules(bots: tuple[str, ...] = ("assistant", "bot")) -> list[tuple[str, str]]:
    return [
        ("bot_prefix", rf"(?isuU)\A\s*(?:{'|'.join(bots)})\s*:\s*"),
        ("name_prefix", r"(?isuU)\A\s*name\s*:\s*"),
        ("speaker_prefix", r"(?sU)\A\s*[A-ZА-ЯЁ][^:\n]{1,40}:\s+"),
    ]


def normalize_response(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """{cleaned, changes}: each rule's prefix removed once, in order, unless nothing would be left."""
    cleaned, changes = strip(F.coalesce(c, F.lit(""))), []
    for reason, pattern in rules or prefix_rules():
        updated = strip(F.regexp_replace(cleaned, pattern, ""))
        changed = (updated != "") & (updated != cleaned)
        changes.append(F.when(changed, F.lit(reason)))
        cleaned = F.when(changed, updated).otherwise(cleaned)
    return F.struct(cleaned.alias("cleaned"), F.filter(F.array(*changes), lambda x: x.isNotNull()).alias("changes"))


def split_lines(c: Column) -> Column:
    """Non-blank lines; a text of one line is cut after sentence ends before a capital or a quote, full stops
    at the ends go, and pieces of one character too."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n|\r"), strip), lambda x: x != "")
    parts = F.filter(F.split(c, r"(?U)(?<=[.!?])\s*(?=[А-ЯA-Z«\"])"), lambda x: strip(x) != "")
    parts = F.transform(parts, lambda x: F.regexp_replace(strip(x), r"\.+\z", ""))
    return F.when(F.size(lines) > 1, lines).otherwise(F.filter(parts, lambda x: F.length(x) > 1))


def join_lines(lines: Column, inline: Column) -> Column:
    """Lines joined by '. ' without their end marks where `inline`, else by line breaks."""
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"[.,!? ]+\z", ""))
    return F.when(F.size(lines) <= 1, F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))).when(inline, F.array_join(bare, ". ")).otherwise(F.array_join(lines, "\n"))


def hash_number(key: Column) -> Column:
    """The first 32 bits of md5(key) as a long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_uniform(key: Column) -> Column:
    """A number from [0, 1) that depends on the key alone."""
    return hash_number(key) / F.lit(float(1 << 32))


def prompt_seed(base: int, prompt_id: Column) -> Column:
    return F.pmod(hash_number(prompt_id) + F.lit(base), F.lit((1 << 31) - 1))


def choose(options: Column, key: Column) -> Column:
    """One element of an array, by hash of the key."""
    return F.element_at(options, (F.pmod(hash_number(key), F.size(options)) + 1).cast("int"))


def chat_trigger(names: list[str], templates: list[str], slot: Column, key: Column) -> Column:
    """`name: template`, both chosen by hash, the template's {slot} filled."""
    name = choose(F.array(*map(F.lit, names)), F.concat(key, F.lit("|name")))
    template = choose(F.array(*map(F.lit, templates)), F.concat(key, F.lit("|template")))
    return F.concat(name, F.lit(": "), F.replace(template, F.lit("{slot}"), slot))


def message_key(messages: Column) -> Column:
    """The key under which equal conversations are found: md5 of role:content joined by |||."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|||").cast("binary"))


def transcript(dialog: Column, bots: bool = True) -> Column:
    """`name: content` lines of {role, name, content}; without bots, those of humans only."""
    kept = dialog if bots else F.filter(dialog, lambda m: m["role"] != "assistant")
    return F.array_join(F.transform(kept, _named), "\n")


def _named(m: Column) -> Column:
    return F.concat(F.coalesce(F.when(m["name"] != "", m["name"]), m["role"]), F.lit(": "), m["content"])


def compact_transcript(dialog: Column, bot_name: str = "assistant") -> Column:
    """Human lines, and the last bot turn alone, placed before the last line."""
    humans = F.transform(F.filter(dialog, lambda m: m["role"] != "assistant"), _named)
    bots = F.filter(dialog, lambda m: m["role"] == "assistant")
    last = F.try_element_at(bots, F.lit(-1))
    line = F.concat(F.coalesce(F.when(last["name"] != "", last["name"]), F.lit(bot_name)), F.lit(": "), last["content"])
    n = F.size(humans)
    placed = F.when(n == 0, F.array(line)).otherwise(F.concat(F.slice(humans, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(line), F.slice(humans, F.greatest(n, F.lit(1)), F.lit(1))))
    return F.array_join(F.when(F.size(bots) > 0, placed).otherwise(humans), "\n")


def containment(a: Column, b: Column) -> Column:
    """Shared distinct elements over the smaller set; 0 where either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def uid(prompt: Column, model: Column, candidate: Column) -> Column:
    return F.concat_ws("::", prompt, model, candidate.cast("string"))


def display_model(model: Column, effort: Column, several: bool) -> Column:
    """The model's name, with its effort where several efforts are compared."""
    return F.when(F.lit(several) & effort.isNotNull(), F.concat(model, F.lit(" ["), effort, F.lit("]"))).otherwise(model) if several else model


def version_of(name: Column, product: str) -> Column:
    """`v12-suffix` of a file or model name `product-v12-suffix-…`; '' where there is none."""
    return F.regexp_extract(name, rf"{product}-(v\d+(?:-\w+?)?)-", 1)


def context_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: strip(x) != "")


def participants(c: Column) -> Column:
    """What stands before the first ': ' of each line that has one."""
    named = F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit(": ")))
    return F.array_distinct(F.transform(named, lambda x: F.substring_index(x, ": ", 1)))


def default_order(candidates: Column) -> Column:
    """Candidates of one prompt in the order in which they are shown: by model, then by number."""
    key = lambda c: F.struct(c["model"].alias("m"), c["candidate_idx"].alias("i"), c.alias("c"))
    return F.transform(F.array_sort(F.transform(candidates, key)), lambda x: x["c"])


def last_of(array: Column, n: int = 15) -> Column:
    """The last n elements, or all."""
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), F.lit(n))


def arguments(c: Column) -> Column:
    """The parts of a list given as one text with commas, without blank ones; null where none is left."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def words(c: Column) -> Column:
    """The runs of non-white space."""
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def token_count(c: Column) -> Column:
    """The default counter: words and signs.  Exact counters are Python functions over a vocabulary."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def token_estimate(c: Column) -> Column:
    return F.length(c) / 3


def preview(c: Column, most: int = 80) -> Column:
    flat = F.replace(c, F.lit("\n"), F.lit(" | "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def truncate_tokens(tokens: Column, most: int, keep: str = "end") -> Column:
    """At most `most` tokens, the last ones (keep='end') or the first."""
    n = F.size(tokens)
    cut = F.slice(tokens, F.greatest(n - most + 1, F.lit(1)), F.lit(most)) if keep == "end" else F.slice(tokens, 1, most)
    return F.when(n > most, cut).otherwise(tokens)


def strip_speaker_tokens(c: Column) -> Column:
    """Without a leading <user_N>, then without a leading <bot>."""
    return strip(F.regexp_replace(strip(F.regexp_replace(c, r"(?U)\A\s*<user_\d+>\s*", "")), r"(?U)\A<bot>\s*", ""))


def label_mask(ids: Column, prefix: list[int], ignore: int = -100) -> Column:
    """Training labels of token ids: `ignore` up to the end of the last occurrence of `prefix`, then the ids;
    all `ignore` where it does not occur."""
    n = F.size(ids)
    if not prefix:
        return ids
    # as text, each number between commas of its own: the last occurrence is one search
    text = F.concat(F.lit(","), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",,"), F.lit(","))
    wanted = "," + ",,".join(str(x) for x in prefix) + ","
    after = F.substring_index(text, wanted, -1)
    kept = F.when(F.contains(text, F.lit(wanted)), ((F.length(after) - F.length(F.replace(after, F.lit(","), F.lit("")))) / 2).cast("int")).otherwise(0)
    return F.concat(F.array_repeat(F.lit(ignore), n - kept), F.slice(ids, n - kept + 1, kept))
