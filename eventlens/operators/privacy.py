"""Masking by role, tokenisation and field encryption, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.fields import string_columns

# Patterns, policies and sensitive field names.
PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CC": r"\b(?:\d[ -]*?){13,16}\b",
    "IPV4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
API_KEY = r"(?i)((?:api|secret|key|token|auth)[-_\s]*[:=])[-_\s]*[a-zA-Z0-9]{16,}"

POLICIES = {
    "admin": {"*": "clear"},
    "analyst": {
        "email": "hash",
        "src_ip": "partial",
        "dst_ip": "partial",
        "credit_card": "redact",
        "ssn": "redact",
        "password": "redact",
        "api_key": "redact",
        "phone": "hash",
    },
    "auditor": {"user": "clear", "action": "clear", "*": "redact"},
}

SENSITIVE_FIELDS = (
    "password",
    "ssn",
    "credit_card",
    "api_key",
    "secret",
    "token",
    "private_key",
    "email",
    "phone",
    "address",
)


def mask_hash(col: Column, salt: str) -> Column:
    """First 16 hex digits of the salted SHA-256."""
    return F.substring(F.sha2(F.concat(col, F.lit(salt)), 256), 1, 16)


def mask_partial(col: Column) -> Column:
    """Addresses lose their last part; other text keeps two characters at either end."""
    parts = F.split(col, r"\.")
    address = F.when(F.size(parts) == 4, F.concat_ws(".", parts[0], parts[1], parts[2], F.lit("xxx"))).otherwise("[MASKED_IP]")
    ends = F.concat(F.substring(col, 1, 2), F.lit("..."), F.substring(col, -2, 2))
    return F.when(col.contains("."), address).when(F.length(col) > 6, ends).when(col.isNotNull(), "[MASKED]")


def mask_patterns(col: Column) -> Column:
    """Mail addresses, social security numbers, card numbers, IPv4 addresses and keyed secrets, in that order."""
    replace = lambda c, name: F.regexp_replace(c, PATTERNS[name], f"[MASKED_{name}]")
    # characters that a match cannot do without: most text is passed over by these cheap tests
    mail = F.when(col.contains("@"), replace(col, "EMAIL")).otherwise(col)
    numbers = F.when(col.rlike("[0-9]"), reduce(replace, ("SSN", "CC", "IPV4"), mail)).otherwise(mail)
    return F.when(col.contains(":") | col.contains("="), F.regexp_replace(numbers, API_KEY, "$1********")).otherwise(numbers)


STRATEGIES = {
    "clear": lambda c: c,
    "redact": lambda c: F.when(c.isNotNull(), "[REDACTED]"),
    "partial": mask_partial,
}


def mask_by_role(role: str, salt: str, policies: dict[str, dict[str, str]] = POLICIES):
    """Mask every string column as the role's policy says; an unknown role counts as analyst.

    `salt` is a secret, other than that of the tokens: with one salt for both, hashes would show which token is whose.
    """
    policy = policies.get(role.lower(), policies["analyst"])
    strategies = STRATEGIES | {"hash": lambda c: mask_hash(c, salt)}

    def apply(df: DataFrame) -> DataFrame:
        masked = {n: strategies.get(policy.get(n, policy.get("*")), mask_patterns)(F.col(f"`{n}`")) for n in string_columns(df)}
        return df.select(*[masked[n].alias(n) if n in masked else F.col(f"`{n}`") for n in df.columns])

    return apply


def token_of(col: Column, salt: str) -> Column:
    """Deterministic token of a value; empty stays empty."""
    token = F.concat(F.lit("detok_"), F.substring(F.sha2(F.concat(col, F.lit(salt)), 256), 1, 16))
    return F.when(col == "", "").otherwise(token)


def tokenize_pii(*columns: str, salt: str):
    """Replace the columns (default email, ssn) by tokens; see `token_vault` for the way back."""
    names = columns or ("email", "ssn")
    return lambda df: df.withColumns({n: token_of(F.col(n), salt) for n in names if n in df.columns})


def token_vault(df: DataFrame, *columns: str, salt: str) -> DataFrame:
    """Distinct (token, value) pairs, to be written to a protected table."""
    names = [n for n in (columns or ("email", "ssn")) if n in df.columns]
    values = df.select(F.explode(F.array(*names)).alias("value")).where("value is not null and value <> ''").distinct()
    return values.select(token_of(F.col("value"), salt).alias("token"), "value")


def encrypt_fields(key_hex: str, fields=SENSITIVE_FIELDS):
    """AES-GCM on the sensitive columns, as `encrypted:<hex>`, with a `<name>_encrypted` marker."""
    key = F.unhex(F.lit(key_hex))

    def apply(df: DataFrame) -> DataFrame:
        result = df
        for n in [c for c in df.columns if c in fields]:
            cipher = F.aes_encrypt(F.encode(F.col(n).cast("string"), "utf-8"), key, F.lit("GCM"))
            result = result.withColumn(n, F.concat(F.lit("encrypted:"), F.lower(F.hex(cipher)))).withColumn(f"{n}_encrypted", F.col(n).isNotNull())
        return result

    return apply


def decrypt_fields(key_hex: str, types: dict[str, str] | None = None):
    """Undo `encrypt_fields` and drop the markers; `types` restores non-string columns."""
    key = F.unhex(F.lit(key_hex))

    def apply(df: DataFrame) -> DataFrame:
        result = df
        for marker in [c for c in df.columns if c.endswith("_encrypted")]:
            n = marker.removesuffix("_encrypted")
            raw = F.unhex(F.regexp_replace(F.col(n), "^encrypted:", ""))
            plain = F.decode(F.aes_decrypt(raw, key, F.lit("GCM")), "utf-8").cast((types or {}).get(n, "string"))
            value = F.when(F.col(marker), plain) if (types or {}).get(n) else F.when(F.col(marker), plain).otherwise(F.col(n))
            result = result.withColumn(n, value).drop(marker)
        return result

    return apply
