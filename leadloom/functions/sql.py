"""The scalar functions as temporary SQL functions, visible to the optimizer."""

from pyspark.sql import SparkSession

from leadloom import dictionaries as D
from leadloom.functions import phones, text

_DIGITS = "regexp_replace(coalesce(if(trim(x) RLIKE r'{f}', coalesce(CAST(try_cast(try_cast(trim(x) AS DOUBLE) AS BIGINT) AS STRING), ''), trim(x)), ''), '[^0-9+]', '')"


def _definitions() -> dict[str, tuple[str, str]]:
    """name -> (result type, SQL body over the argument x)."""
    mobile = "|".join(p[1:] for p in D.MOBILE_PREFIXES)
    body = rf"nullif(regexp_extract({_DIGITS.format(f=phones._FLOAT_TEXT)}, r'^\+?(?:84|0)?((?:{mobile})[0-9]{{7}})$', 1), '')"
    codes = sorted(D.LANDLINE_PROVINCE, key=lambda code: (-len(code), code))
    table = ", ".join(f"'{k}', '{v}'" for k, v in D.LANDLINE_PROVINCE.items())
    local = "regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), '[^0-9]', ''), '^84(?=[0-9]{9}$)', '0'), '^(?!0)', '0')"
    return {
        "phone_e164": ("STRING", f"concat('+84', {body})"),
        "phone_local": ("STRING", f"concat('0', {body})"),
        "phone_valid": ("BOOLEAN", f"{body} IS NOT NULL"),
        "email_clean": ("STRING", f"nullif(lower(regexp_extract(trim(x), r'{text._EMAIL}', 0)), '')"),
        "uid_extract": ("STRING", "nullif(regexp_extract(coalesce(x, ''), '([0-9]{9,})', 1), '')"),
        "phone_province": ("STRING", f"coalesce(element_at(map({table}), regexp_extract({local}, '^({'|'.join(codes)})', 1)), 'Unknown')"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    definitions = _definitions()
    for name, (kind, body) in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    return list(definitions)
