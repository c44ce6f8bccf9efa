"""Normalisation of names and attributes, and the identity of its configuration."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The default configuration.
PREFIXES = ("run_", "rfnd_", "ord-", "customer-", "cust_", "session_", "sess-", "req_", "trace-")
VOLATILE = ("agent.run.id", "agent.order.id", "agent.idempotency.key_hash", "service.instance.id", "trace_id", "span_id", "parent_span_id", "timestamp", "duration_nano")
CASELESS = ("agent.side_effect", "agent.data_domain", "agent.step.category")
IDENTITY = ("agent.side_effect", "agent.data_domain", "agent.step.category", "gen_ai.tool.name", "gen_ai.operation.name")
SEPARATORS = "/.: =?&#,;@"
SIDE_EFFECTS = ("none", "read", "write", "external")


@dataclass(frozen=True)
class Config:
    version: str = "1.0.0"
    aliases: dict[str, str] = field(default_factory=dict)
    prefixes: tuple[str, ...] = PREFIXES
    numbers: bool = True
    volatile: tuple[str, ...] = VOLATILE
    caseless: tuple[str, ...] = CASELESS
    identity: tuple[str, ...] = IDENTITY
    placeholder: str = "{id}"

    def hash(self) -> str:
        """SHA-256 of the configuration as JSON with sorted lists."""
        fields = {
            "version": self.version, "aliases": dict(sorted(self.aliases.items())), "identifierPrefixes": sorted(self.prefixes),
            "replaceNumericSegments": self.numbers, "volatileAttributes": sorted(self.volatile), "caseInsensitiveAttributes": sorted(self.caseless),
            "fingerprintAttributes": sorted(self.identity), "identifierPlaceholder": self.placeholder,
        }
        return hashlib.sha256(json.dumps(fields, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


DEFAULT = Config()


@F.pandas_udf(T.StringType())
def _nfc(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFC")


def composed(text: Column, unicode: bool = True) -> Column:
    """Trimmed text in Unicode's composed form. Spark has no function for it; `unicode=False` leaves it out for names that
    are known to be ASCII, and keeps the plan without Python."""
    cut = F.trim(text)
    return F.when(cut.rlike(r"[^\x00-\x7F]"), _nfc(cut)).otherwise(cut) if unicode else cut


def token(word: Column, config: Config) -> Column:
    """The placeholder for a word that is an identifier, with its prefix if that is a known one."""
    whole = [r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"(?i)^[0-7][0-9A-HJKMNP-TV-Z]{25}$", "(?i)^[0-9a-f]{16,}$"]
    if config.numbers:
        whole.append("^[0-9]+$")
    is_id = F.lit(False)
    for pattern in whole:
        is_id = is_id | word.rlike(pattern)
    out = F.when(is_id, config.placeholder)
    for prefix in config.prefixes:
        out = out.when(word.startswith(prefix) & (F.length(word) > len(prefix)), prefix + config.placeholder)
    return out.otherwise(word)


def normalised_name(name: Column, config: Config = DEFAULT, unicode: bool = True) -> Column:
    """A name with its volatile parts replaced: an alias as a whole, or each part between separators."""
    base = composed(name, unicode)
    parts = F.split(base, f"(?<=[{re.escape(SEPARATORS)}])|(?=[{re.escape(SEPARATORS)}])")
    plain = F.array_join(F.transform(parts, lambda w: token(w, config)), "")
    if not config.aliases:
        return plain
    aliases = F.create_map(*(F.lit(x) for kv in config.aliases.items() for x in kv))
    return F.coalesce(F.element_at(aliases, base), plain)


def side_effect(raw: Column) -> Column:
    """A known side effect in lower case, else `unknown`, never `none`."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin(*SIDE_EFFECTS), low).otherwise("unknown")


def non_negative_integer(raw: Column) -> Column:
    """A whole number of 0 or more from a number or a string of digits; else null."""
    text = F.trim(raw.cast("string"))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def key_hash(salt: str, key: Column) -> Column:
    """SHA-256 of a key under a salt, so that the key itself is not kept."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), key), 256)


def cursor(key: Column) -> Column:
    """A place in a list as URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(key.cast("binary")), "+/\n", "-_"), F.lit("="))


def cursor_key(text: Column) -> Column:
    """The place that a cursor names."""
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")).cast("string")


def filled(text: Column) -> Column:
    """Trimmed text; null if empty."""
    return F.nullif(F.trim(text), F.lit(""))


def canonical_json(value) -> str:
    """JSON with keys sorted at every depth and without spaces; numbers that are not finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def safe_text(text: str, most: int = 200) -> str:
    """Composed text without control, direction and zero-width characters, cut by code points."""
    kept = "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c) not in ("Cc", "Cf", "Cs", "Co", "Cn"))
    return kept[:most]


def rule_id(prefix: str, label: str) -> str:
    """A readable id with eight hex digits of the label's digest, so that labels that read alike have ids of their own."""
    slug = re.sub("-+", "-", re.sub("[^a-z0-9]", "-", label.lower())[:80]).strip("-")
    return "-".join(x for x in (prefix, slug, hashlib.sha256(label.encode()).hexdigest()[:8]) if x)[:128]


def margin_up(value: int, percent: int) -> int:
    """A number raised by a percentage, rounded up."""
    return math.ceil(value * (100 + percent) / 100) if value < 2**40 else -(-value * (100 + percent) // 100)
