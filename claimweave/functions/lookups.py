"""Fixed lookups: countries and file categories."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.text import strip

# Country codes and the names that stand for them, besides the code itself.
COUNTRIES = {
    "AL": ["ALBANIA"],
    "AU": ["AUSTRALIA"],
    "BE": ["BELGIUM"],
    "BG": ["BULGARIA"],
    "CH": ["SWITZERLAND"],
    "CN": ["CHINA", "PEOPLE'S REPUBLIC OF CHINA"],
    "CY": ["CYPRUS", "REPUBLIC OF CYPRUS"],
    "DE": ["GERMANY"],
    "DK": ["DENMARK"],
    "EG": ["EGYPT"],
    "ES": ["SPAIN"],
    "FR": ["FRANCE"],
    "GB": ["UNITED KINGDOM", "UK", "GREAT BRITAIN", "BRITAIN"],
    "GR": ["GREECE"],
    "HK": ["HONG KONG", "HONGKONG"],
    "ID": ["INDONESIA"],
    "IL": ["ISRAEL"],
    "IN": ["INDIA"],
    "IT": ["ITALY"],
    "JP": ["JAPAN"],
    "KR": ["SOUTH KOREA", "KOREA", "REPUBLIC OF KOREA"],
    "LA": ["LAOS", "LAO"],
    "MO": ["MACAU", "MACAO"],
    "MY": ["MALAYSIA"],
    "PH": ["PHILIPPINES", "PHILIPPINE"],
    "RO": ["ROMANIA"],
    "RU": ["RUSSIAN FEDERATION", "RUSSIA"],
    "SA": ["SAUDI ARABIA", "SAUDI"],
    "SE": ["SWEDEN"],
    "SG": ["SINGAPORE"],
    "TH": ["THAILAND"],
    "TR": ["TURKEY"],
    "TW": ["TAIWAN"],
    "VT": ["VIETNAM", "VIET NAM"],
}

# File extensions per category.
FILE_CATEGORIES = {
    "text": [".txt", ".log", ".md", ".rst", ".nfo"],
    "markup": [".html", ".xml", ".json", ".jsonl", ".yaml", ".yml", ".ini", ".cfg", ".toml", ".conf", ".properties"],
    "documentation": [".tex", ".ltx", ".srt", ".vtt", ".po", ".pot", ".org", ".wiki", ".bbcode", ".texinfo"],
    "image": [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif", ".pbm", ".pgm", ".ppm", ".gif", ".raw", ".cr2", ".nef", ".arw", ".dng"],
    "vector": [".svg"],
    "word": [".docx", ".dotx", ".doc", ".odt", ".rtf", ".pages"],
    "pdf": [".pdf"],
    "ebook": [".epub", ".mobi", ".azw", ".azw3"],
    "spreadsheet": [".xls", ".xlsx", ".xlsm", ".ods", ".csv", ".tsv", ".numbers"],
    "archive": [".zip", ".tar", ".gz", ".bz2", ".7z", ".xz", ".rar", ".tgz"],
    "code": [".py", ".js", ".ts", ".java", ".cpp", ".c", ".h", ".go", ".rs", ".sh", ".ps1", ".sql", ".php", ".rb", ".swift", ".ipynb"],
    "email": [".msg", ".eml", ".ics", ".vcf", ".vcard"],
    "web_archive": [".mhtml", ".mht", ".har"],
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A constant map; it is folded into the plan, so no join is needed."""
    entries = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*entries), key)


def normalize_country(name: str | Column) -> Column:
    """A country name or code in any case as a two-letter code; NULL when unknown."""
    table = {alias: code for code, names in COUNTRIES.items() for alias in [code, *names]}
    return _lookup(table, F.upper(strip(name)))


def is_supported_country(name: str | Column) -> Column:
    return normalize_country(name).isNotNull()


def _categories() -> dict[str, str]:
    listed = {extension: category for category, extensions in FILE_CATEGORIES.items() for extension in extensions}
    # Unlisted extensions fall back to their registered media type.
    for extension, media in sorted(mimetypes.MimeTypes().types_map[True].items()):
        family = media.split("/")[0]
        category = "pdf" if media == "application/pdf" else family if family in ("text", "image") else None
        if category:
            listed.setdefault(extension, category)
    return listed


def file_category(path: str | Column) -> Column:
    """Category of a file name by its extension, else ``unknown``."""
    column = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(column, r"([^/]*)/*$", 1)
    extension = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    compound = name.rlike(r"\.tar\.(gz|bz2|xz)$")
    return F.when(compound, "archive").otherwise(F.coalesce(_lookup(_categories(), extension), F.lit("unknown")))
