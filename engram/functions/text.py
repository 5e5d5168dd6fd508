"""Text functions, as Column expressions: fingerprints, classification by pattern, cleaning and parsing.

Null texts give null unless a docstring says otherwise. Blanks are ASCII blanks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"\s+"

#: What makes a text restricted; the first that fits gives the reason.
RESTRICTED = [
    ("ssn_pattern", r"\b\d{3}-?\d{2}-?\d{4}\b"),
    ("passport_pattern", r"\b[A-Z]{1,2}\d{6,9}\b"),
    ("bank_account", r"(?i)\b\d{8,17}\b.*\b(account|routing|iban)\b"),
    ("bank_account", r"(?i)\b(account|routing)\b.*\b\d{8,17}\b"),
    ("api_key", r"(?i)\b(sk-|pk_live_|sk_live_|ghp_|gho_|AKIA)[A-Za-z0-9]{10,}"),
    ("password_value", r"(?i)\bpassword\s*[:=]\s*\S+"),
    ("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
]
#: What makes a text personal; all that fit are reasons.
PERSONAL = [
    ("medication_dosage", r"(?i)\b\d+\s*mg\b(?!\s*/\s*(dL|kg|L|ml))"),
    ("drug_name", r"(?i)\b(pregabalin|metoprolol|losartan|lisinopril|aspirin|atorvastatin|sertraline|metformin|gabapentin|prednisone|insulin|warfarin)\b"),
    ("health_measurement", r"(?i)\b(glucose|a1c|cholesterol|blood pressure|bp|hrv|bmi)\b.*\b\d+"),
    ("medical_condition", r"(?i)\b(diagnosed|diagnosis|prediabetic|diabetic|arrhythmia|ablation)\b"),
    ("financial_detail", r"(?i)\b(salary|income|net worth|401k|ira|portfolio)\b.*\b\$?\d"),
    ("financial_amount", r"(?i)\b\$\d{3,}[,\d]*\b"),
]
#: Secrets in notes; the first that fits is the label.
SECRETS = [
    ("OpenAI/OpenRouter API key", r"sk-(?:or-v1-|proj-|live-)?[a-zA-Z0-9]{20,}"),
    ("JWT token", r"eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}"),
    ("GitHub token", r"gh[ps]_[a-zA-Z0-9]{36,}"),
    ("GitHub OAuth token", r"gho_[a-zA-Z0-9]{36,}"),
    ("AWS access key", r"AKIA[0-9A-Z]{16}"),
    ("Supabase key", r"sbp_[a-zA-Z0-9]{20,}"),
    ("Private key block", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----"),
    ("Generic secret assignment", r"""(?i)(?:password|secret|token|api_key|apikey|api_secret|access_token|auth_token)\s*[=:]\s*["']?[a-zA-Z0-9_\-/.]{16,}"""),
    ("Connection string with credentials", r"(?i)(?:postgres|mysql|mongodb|redis)://[^:]+:[^@]+@"),
]
#: Names of thought types and what they stand for.
TYPE_ALIASES = {
    "idea": "idea", "task": "task", "person": "person_note", "person_note": "person_note", "reference": "reference", "ref": "reference", "note": "reference",
    "decision": "decision", "lesson": "lesson", "meeting": "meeting", "event": "meeting", "journal": "journal",
}
#: HTML tags and what they become in text, in this order.
HTML_TAGS = [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)</div>", "\n"), (r"(?i)</li>", "\n"), (r"(?i)</h[1-6]>", "\n\n"), (r"(?i)</tr>", "\n"), (r"(?i)<li[^>]*>", "- "), (r"<[^>]+>", "")]
#: HTML entities, in this order.
HTML_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'")]
#: Rules by which a text without metadata gets its type, and topics by what it contains.
FALLBACK_TYPES = [("task", r"\b(todo|next step|ship|implement|fix|review|publish)\b"), ("decision", r"\b(decided|decision|must|should)\b"), ("reference", r"\b(recipe|docs|reference|guide|url|http)\b")]
#: Words between clauses.
CONJUNCTIONS = [" and ", " but ", " however ", " also ", " additionally "]


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Pattern after pattern; replacements hold no group references."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text in lower case with blanks collapsed. The empty text has one too."""
    return F.sha2(F.lower(collapsed(text)), 256)


def loose_normal(text: Column) -> Column:
    """Also without final punctuation, possessives and a final s of a word of more than four letters."""
    s = F.lower(collapsed(F.coalesce(text, F.lit(""))))
    return F.trim(replaced(s, [(r"[.!?;:,]+$", ""), (r"['’]s\b", ""), (r"([a-z0-9_]{4,})s$", "$1")]))


def loose_fingerprint(text: Column) -> Column:
    """SHA-256 of the loose normal form, the empty string for an empty one."""
    normal = loose_normal(text)
    return F.when(normal == "", "").otherwise(F.sha2(normal, 256))


def short_hash(*parts: Column, sep: str = "|", size: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, size)


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), BLANKS, " "), r"[^A-Za-z0-9_ ]", ""))


def token_set(text: Column) -> Column:
    """Distinct runs of three or more letters a-z and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), 0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def first_label(text: Column, patterns: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def all_labels(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns]))


def sensitivity(text: Column) -> tuple[Column, Column]:
    """(tier, reasons): restricted by the first pattern that fits, else personal by all that do, else standard."""
    # one value to a row, so that each pattern is looked for once at most, and the soft ones only where no hard one fits
    empty = F.array().cast("array<string>")
    hard = F.transform(F.array(text), lambda x: F.struct(x.alias("text"), first_label(x, RESTRICTED).alias("hard")))
    found = F.transform(hard, lambda x: F.struct(x["hard"].alias("hard"), F.when(x["hard"].isNotNull(), F.array(x["hard"])).otherwise(F.coalesce(all_labels(x["text"], PERSONAL), empty)).alias("reasons")))
    one = F.element_at(F.transform(found, lambda x: F.struct(F.when(x["hard"].isNotNull(), "restricted").when(F.size(x["reasons"]) > 0, "personal").otherwise("standard").alias("tier"), x["reasons"].alias("reasons"))), 1)
    return one["tier"], one["reasons"]


def resolved_tier(detected: Column, override: Column) -> Column:
    """The stricter of the two; an override that isn't a tier counts as personal."""
    order = F.array(F.lit("standard"), F.lit("personal"), F.lit("restricted"))
    given = F.when(override.isNull(), 0).otherwise(F.greatest(F.array_position(order, override), F.when(F.array_position(order, override) == 0, 2).otherwise(0)))
    return F.element_at(order, F.greatest(F.array_position(order, detected), given, F.lit(1)).cast("int"))


def secret_label(text: Column) -> Column:
    return first_label(text, SECRETS)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def unsafe_reasons(text: Column) -> Column:
    """Why a text shouldn't be written back, in a fixed order."""
    speaker = lambda x: F.trim(x).rlike("(?i)^(user|assistant|system|agent|human):")
    return F.array_compact(F.array(
        F.when(text.rlike("-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----"), "private_key"),
        F.when(text.rlike("(?:sk-[A-Za-z0-9_-]{20,}|sk-or-v1-[A-Za-z0-9_-]{20,})"), "api_key"),
        F.when(text.rlike(r"(?i)(?:password|passwd|secret|token)\s*[:=]\s*\S{12,}"), "credential_like_string"),
        F.when((F.regexp_count(text, F.lit("```")) >= 4) | (F.size(F.filter(lines(text), lambda x: F.length(x) > 120)) > 20), "large_code_block"),
        F.when((F.length(text) > 15000) | (F.size(F.filter(lines(text), speaker)) > 8), "raw_transcript_like"),
    ))


def html_to_text(html: Column, once: bool = False) -> Column:
    """Text of HTML. Entities are replaced in the fixed order, by which &amp;lt; gets <; once, the ampersand goes last and it gets &lt;."""
    entities = sorted(HTML_ENTITIES, key=lambda x: once and x[1] == "&")
    s = replaced(html, [*HTML_TAGS, *entities, (r"[ \t]+", " "), (r"\n{3,}", "\n\n")])
    return F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def _before(text: Column, stops) -> Column:
    """The lines before the first one that stops: stops(line, index, all lines)."""
    ls = lines(text)
    hits = F.filter(F.transform(ls, lambda x, i: F.when(stops(x, i, ls), i)), lambda i: i.isNotNull())
    kept = F.when(F.size(hits) > 0, F.slice(ls, F.lit(1), hits[0])).otherwise(ls)
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def strip_quoted(text: Column) -> Column:
    """A mail without what it replies to. Rules that need a line before them don't hold on the first line."""

    def stops(x: Column, i: Column, ls: Column) -> Column:
        s = F.trim(x)
        ahead = F.array_join(F.slice(ls, i + 1, F.lit(4)), " ")
        wrote = s.rlike("(?i)^On .+ wrote:$") | (s.rlike("(?i)^On .+") & ~s.endswith("wrote:") & ahead.rlike("(?i)^On .+ wrote:$"))
        marks = s.rlike(r"(?i)^-{3,}\s*Original Message\s*-{3,}$") | s.rlike("^_{3,}$") | s.rlike(r"(?i)^-{5,}\s*Forwarded message")
        return wrote | marks | ((i > 0) & (s.rlike("^From:.*@") | s.startswith(">")))

    return _before(text, stops)


def strip_signature(text: Column) -> Column:
    """A mail up to its closing, which stays, or up to a dashed line or a phone's line, which go."""
    ls = lines(text)
    near_end = lambda i: i > F.size(ls) - 8
    closing = F.filter(F.transform(ls, lambda x, i: F.when(near_end(i) & F.trim(x).rlike("(?i)^(regards|best|thanks|cheers|sincerely|sent from)"), i + 1)), lambda i: i.isNotNull())
    rest = lambda i: F.lower(F.array_join(F.slice(ls, i + 1, F.lit(8)), "\n"))
    phone = lambda i: near_end(i) & (F.contains(rest(i), F.lit("sent from my iphone")) | F.contains(rest(i), F.lit("sent from my ipad")))
    dashed = F.filter(F.transform(ls, lambda x, i: F.when((F.trim(x) == "--") | (phone(i) & ~F.trim(x).rlike("(?i)^(regards|best|thanks|cheers|sincerely|sent from)")), i)), lambda i: i.isNotNull())
    end = F.least(F.when(F.size(closing) > 0, closing[0]), F.when(F.size(dashed) > 0, dashed[0]), F.size(ls))
    return F.regexp_replace(F.array_join(F.slice(ls, F.lit(1), end), "\n"), r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, BLANKS), lambda x: x != "")).cast("bigint")


def type_of_alias(value: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(value)), BLANKS, "_")
    return first_equal(key, TYPE_ALIASES)


def first_equal(value: Column, names: dict[str, str]) -> Column:
    return reduce(lambda out, kv: F.when(value == kv[0], F.lit(kv[1])).otherwise(out), names.items(), F.lit(None).cast("string"))


#: Fixed value: the form of a structured capture, which stays on one line.
STRUCTURED = r"(?i)^\s*\[([^\]]+)\]\s*\[([^\]]+)\]\s*(.+?)(?:\s*\+\s*(.+))?$"


def structured_capture(text: Column) -> dict[str, Column]:
    """Parts of "[type] [topic] body + next step": matched, kind, topic, next_step, normalized."""
    s = F.trim(text)
    part = lambda k: F.nullif(F.trim(F.regexp_extract(s, STRUCTURED, k)), F.lit(""))
    matched, step = s.rlike(STRUCTURED), F.substring(part(4), 1, 180)
    body = F.coalesce(part(3), F.lit(""))
    normalized = F.when(~matched, s).when(step.isNotNull(), F.concat(body, F.lit(" Next step: "), step)).otherwise(body)
    return {"matched": matched, "kind": type_of_alias(part(1)), "topic": F.substring(part(2), 1, 80), "next_step": step, "normalized": normalized}


def with_evergreen(text: Column, tags: Column) -> Column:
    has = F.exists(tags, lambda x: F.lower(x) == "evergreen")
    return F.when(text.rlike(r"(?i)\bevergreen\b") & ~has, F.array_append(tags, F.lit("evergreen"))).otherwise(tags)


def is_compound(text: Column) -> Column:
    """Whether a text holds several thoughts: by sentences, lists, semicolons or conjunctions."""
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda x: F.length(F.trim(x)) >= 10))
    joins = reduce(lambda a, c: a + F.regexp_count(F.lower(text), F.lit(c)), CONJUNCTIONS, F.lit(0))
    lists = text.rlike(r"(^|\n)\s*\d+\.\s") | text.rlike(r"(^|\n)\s*[-•*]\s")
    return F.coalesce((sentences >= 3) | lists | (F.regexp_count(text, F.lit(";")) >= 2) | (joins >= 3), F.lit(False))


def head_tail(text: Column, head: int = 12_000, tail: int = 4_000, marker: str = "\n\n[... truncated ...]\n\n") -> Column:
    return F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit(marker), F.substring(text, -tail, tail))).otherwise(text)


def wikilinks(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+?)(\|[^\]]+)?\]\]"), 1), lambda x: F.trim(x)))


def inline_tags(text: Column) -> Column:
    """Distinct #tags outside code, comments and HTML tags, in order."""
    s = replaced(text, [(r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"<!--[\s\S]*?-->", ""), (r"<[^>]+>", "")])
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"(^|[^A-Za-z0-9_])#([A-Za-z0-9_/-]+)"), 2))


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1."""
    return F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def preview(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def safe_preview(text: Column) -> Column:
    return collapsed(replaced(F.coalesce(text, F.lit("")), [(r"[\r\n]+", " "), (r"[`\[\]]", "")]))


def scrubbed(text: Column) -> Column:
    """Without control characters, tags that close the surrounding fence, and phrases that give orders."""
    return replaced(F.coalesce(text, F.lit("")), [
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"(?i)<\s*/?\s*thought\b[^>]*>", "[thought-tag-redacted]"), (r"(?i)ignore\s+(all\s+)?previous\s+instructions?", "[redacted injection attempt]"),
        (r"(?i)disregard\s+(the\s+)?above", "[redacted injection attempt]"), (r"(?i)new\s+instructions\s*:", "[redacted injection attempt]"),
    ])


EMAIL = r"^[^\s@<>,]+@[^\s@<>,]+\.[^\s@<>,]+$"


def addresses(header: Column) -> Column:
    """Addresses of a mail header as (name, email); commas within quotes or angle brackets don't divide. What isn't an address goes."""
    parts = F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r'((?:"(?:\\.|[^"\\])*"|<[^>]*>|[^,"<])+)'), 1)
    angle = r"^(.*?)<([^>]+)>\s*$"

    def parse(x: Column) -> Column:
        s = F.trim(x)
        has = s.rlike(angle)
        name = F.when(has, F.trim(F.regexp_replace(F.trim(F.regexp_extract(s, angle, 1)), "^[\"']|[\"']$", ""))).otherwise("")
        return F.struct(name.alias("name"), F.when(has, F.trim(F.regexp_extract(s, angle, 2))).otherwise(s).alias("email"))

    return F.filter(F.transform(parts, parse), lambda a: a["email"].rlike(EMAIL))


def best_name(existing: Column, candidate: Column, email: Column) -> Column:
    """A display name in place of a bare address, and nothing else."""
    bare = existing.isNull() | (existing == "") | existing.eqNullSafe(email) | existing.rlike(EMAIL)
    return F.when(bare & (F.coalesce(candidate, F.lit("")) != ""), candidate).otherwise(existing)


def entity_name(text: Column, size: int = 200) -> Column:
    return F.substring(F.lower(collapsed(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "))), 1, size)


def cadence(text: Column) -> Column:
    has = lambda *xs: reduce(lambda a, x: a | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(x)), xs, F.lit(False))
    return F.when(has("month", "quarter"), "monthly").when(has("week"), "weekly").when(has("day", "morning", "afternoon", "evening"), "daily").otherwise("event_driven")


def fallback_type(text: Column) -> Column:
    return F.coalesce(first_label(F.lower(text), FALLBACK_TYPES), F.lit("observation"))


def fallback_topics(text: Column, names: dict[str, str], default: str) -> Column:
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(k)), F.lit(v)) for k, v in names.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def unfenced(text: Column) -> Column:
    """The JSON of a model's answer, without the fence around it."""
    return F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*|\s*```$", "")


UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"


def uuids(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(UUID), 0), F.lower))


def mail_parts(text: Column) -> tuple[Column, Column]:
    """(prefix, body) of "[Email ...] body"; null and the text without one."""
    pattern = r"(?s)^(\[Email[^\]]*\])\s*(.*)$"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).otherwise(text)


def first_path(metadata: Column, keys: list[str]) -> Column:
    """The first of the keys that a JSON object has."""
    return F.coalesce(*[F.get_json_object(metadata, f"$.{k}") for k in keys])
