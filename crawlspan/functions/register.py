"""The column functions under SQL names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crawlspan.functions import html, lang, media, ner
from crawlspan.session import ship

#: SQL functions made of built-in expressions: name -> (parameters, result, body).
EXPRESSIONS = {
    "web_host": ("u STRING", "STRING", r"CASE WHEN u RLIKE r'^(?i)(https?|ftp)://' THEN regexp_extract(u, r'^(?i)(https?|ftp)://(?:[^/?#@]*@)?([^/:?#]*)', 2) WHEN u RLIKE r'^(?i)(file|mailto|jar):' THEN '' END"),
    "without_www": ("h STRING", "STRING", r"regexp_replace(h, r'^\s*www\.', '')"),
    "reverse_host": ("h STRING", "STRING", r"array_join(reverse(split(regexp_extract(h, '^([^:]*)', 1), '[.]')), '.') || regexp_extract(h, '(:.*)?$', 0)"),
    "crawl_month": ("d STRING", "STRING", "substring(d, 1, 6)"),
    "hashtags": ("t STRING", "ARRAY<STRING>", "regexp_extract_all(t, '#[^ ]+', 0)"),
    "mentions": ("t STRING", "ARRAY<STRING>", "regexp_extract_all(t, '@[A-Za-z_0-9]+', 0)"),
    "urls_in": ("t STRING", "ARRAY<STRING>", "regexp_extract_all(t, 'https?://[^ ]+', 0)"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL in this session, and `links(url, html)` a table function."""
    ship(spark)
    for name, (parameters, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    tag = ner.rule_tagger()
    arrow = {
        "extract_links": (html.links_of, html.LINKS, html._LINK),
        "extract_image_links": (html.images_of, "array<string>", pa.list_(pa.string())),
        "remove_html": (html.text_of, "string", pa.string()),
        "main_text": (html.main_text_of, "string", pa.string()),
        "detect_language": (lang.detect, "string", pa.string()),
        "image_size": (lambda d: dict(zip(("width", "height"), media.size_of(d))), "struct<width:int,height:int>", media._SIZE),
        "entities": (lambda t: list(ner.entities(t, tag).items()), "map<string,array<string>>", pa.map_(pa.string(), pa.list_(pa.string()))),
    }
    for name, (f, kind, type_) in arrow.items():
        spark.udf.register(name, html._udf(f, kind, type_))

    @F.udtf(returnType="src string, dst string, anchor string")
    class Links:
        def eval(self, url: str, page: str):
            for x in html.links_of(url, page, url):
                yield x["src"], x["dst"], x["anchor"]

    spark.udtf.register("links", Links)
