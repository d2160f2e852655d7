"""The functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from morphlake.functions.lexer import ANY, PUNCTUATION


@F.udtf(returnType="pos int, token string, type int")
class TokenizeText:
    """tokenize_text(text): a row for each token, for lateral joins; tables are better lexed by lexer.exploded."""

    def eval(self, text: str):
        import re

        if text is None:
            return
        kinds = ((r"[А-Яа-яЁё]", 16), (r"[A-Za-z]", 4), (r"[0-9]", 8), (r"[ \u00a0]", 1), (r"\n", 2), (PUNCTUATION, 32), (r"(?s).", 64))
        for pos, m in enumerate(re.finditer(ANY, text)):
            yield pos, m[0], next(k for p, k in kinds if re.match(p, m[0]))


def register(spark: SparkSession) -> None:
    """Make tokenize_text (table function), and the temporary SQL functions tokens, token_type and ru_words known."""
    spark.udtf.register("tokenize_text", TokenizeText)
    q = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create or replace temporary function tokens(t string) returns array<string> return regexp_extract_all(t, '{q(ANY)}', 1)")
    spark.sql("create or replace temporary function ru_words(t string) returns array<string> return regexp_extract_all(lower(t), '([а-яё]+)', 1)")
    spark.sql(
        "create or replace temporary function token_type(t string) returns int return case when t rlike '^[А-Яа-яЁё]' then 16 when t rlike '^[A-Za-z]' then 4 "
        f"when t rlike '^[0-9]' then 8 when t in (' ', '\u00a0') then 1 when t = '\\n' then 2 when t rlike '^{q(PUNCTUATION)}' then 32 else 64 end"
    )
