"""Explicit schemas of every input and stored table; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS, _DT = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.DateType()

# The columns of an event export, in file order.
EVENT_COLUMNS = """
globaleventid sqldate monthyear year fractiondate
actor1code actor1name actor1countrycode actor1knowngroupcode actor1ethniccode actor1religion1code actor1religion2code actor1type1code actor1type2code actor1type3code
actor2code actor2name actor2countrycode actor2knowngroupcode actor2ethniccode actor2religion1code actor2religion2code actor2type1code actor2type2code actor2type3code
isrootevent eventcode eventbasecode eventrootcode quadclass goldsteinscale nummentions numsources numarticles avgtone
actor1geo_type actor1geo_fullname actor1geo_countrycode actor1geo_adm1code actor1geo_adm2code actor1geo_lat actor1geo_long actor1geo_featureid
actor2geo_type actor2geo_fullname actor2geo_countrycode actor2geo_adm1code actor2geo_adm2code actor2geo_lat actor2geo_long actor2geo_featureid
actiongeo_type actiongeo_fullname actiongeo_countrycode actiongeo_adm1code actiongeo_adm2code actiongeo_lat actiongeo_long actiongeo_featureid
dateadded sourceurl
""".split()
# Which of them hold numbers.
LONG_COLUMNS = ["globaleventid", "sqldate", "dateadded"]
INT_COLUMNS = ["monthyear", "year", "isrootevent", "quadclass", "nummentions", "numsources", "numarticles", "actor1geo_type", "actor2geo_type", "actiongeo_type"]
FLOAT_COLUMNS = ["fractiondate", "goldsteinscale", "avgtone", "actor1geo_lat", "actor1geo_long", "actor2geo_lat", "actor2geo_long", "actiongeo_lat", "actiongeo_long"]


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: An export as read: strings only.
RAW_EVENT = struct(**{c: _S for c in EVENT_COLUMNS})


def event_type(column: str) -> T.DataType:
    return _L if column in LONG_COLUMNS else _I if column in INT_COLUMNS else _D if column in FLOAT_COLUMNS else _S


EVENTS = struct(
    id=_L, source_file=_S, **{c: event_type(c) for c in EVENT_COLUMNS}, ingested_at=_TS, title=_S, article_content=_S, title_last_fetch_at=_TS, title_fetch_status=_S,
    title_fetch_error=_S, title_fetch_attempts=_I, title_next_retry_at=_TS,
)
PROCESSED_FILES = struct(file_name=_S, file_url=_S, processed_at=_TS)
SITEMAPS = struct(sitemap_url=_S, sitemap_lastmod=_S, target_date=_DT, discovered_at=_TS, processed_at=_TS, urls_in_sitemap=_I, extracted_ok=_I, extracted_failed=_I)
ARTICLES = struct(
    url=_S, first_seen_at=_TS, last_seen_at=_TS, fetch_attempts=_I, is_chunked=_B, sitemap_url=_S, sitemap_lastmod=_S, sitemap_article_lastmod=_S, sitemap_image_url=_S,
    fetch_status=_S, fetch_error=_S, http_status=_I, fetched_at=_TS, final_url=_S, extraction_status=_S, extraction_error=_S, extracted_at=_TS, title=_S, author=_S,
    hostname=_S, sitename=_S, date_published=_S, language=_S, excerpt=_S, categories=T.ArrayType(_S), tags=T.ArrayType(_S), text_content=_S, raw_sitemap=_S, raw_metadata=_S,
)
CHUNKS = struct(id=_L, article=_S, chunk=_S, embedding=T.ArrayType(T.FloatType()))
ENTITIES = struct(id=_L, text=_S, type=_S)
ARTICLE_ENTITIES = struct(id=_L, g1_article_url=_S, g1_entities_id=_L)
CANDIDATES = struct(title=_S, url=_S)
SITEMAP_ENTRY = struct(loc=_S, lastmod=_S)
ARTICLE_ENTRY = struct(loc=_S, lastmod=_S, image_loc=_S)
