"""Categories of shows (main and sub) and languages by code, as plain look-ups and as small tables to join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Main categories with their subcategories.
CATEGORIES = {
    "Arts": ["Books", "Design", "Fashion & Beauty", "Food", "Performing Arts", "Visual Arts"],
    "Business": ["Careers", "Entrepreneurship", "Investing", "Management", "Marketing", "Non-Profit"],
    "Comedy": ["Comedy Interviews", "Improv", "Stand-Up"],
    "Education": ["Courses", "How To", "Language Learning", "Self-Improvement"],
    "Fiction": ["Comedy Fiction", "Drama", "Science Fiction"],
    "Government": [],
    "History": [],
    "Health & Fitness": ["Alternative Health", "Fitness", "Medicine", "Mental Health", "Nutrition", "Sexuality"],
    "Kids & Family": ["Education for Kids", "Parenting", "Pets & Animals", "Stories for Kids"],
    "Leisure": ["Animation & Manga", "Automotive", "Aviation", "Crafts", "Games", "Hobbies", "Home & Garden", "Video Games"],
    "Music": ["Music Commentary", "Music History", "Music Interviews"],
    "News": ["Business News", "Daily News", "Entertainment News", "News Commentary", "Politics", "Sports News", "Tech News"],
    "Religion & Spirituality": ["Buddhism", "Christianity", "Hinduism", "Islam", "Judaism", "Religion", "Spirituality"],
    "Science": ["Astronomy", "Chemistry", "Earth Sciences", "Life Sciences", "Mathematics", "Natural Sciences", "Nature", "Physics", "Social Sciences"],
    "Society & Culture": ["Documentary", "Personal Journals", "Philosophy", "Places & Travel", "Relationships"],
    "Sports": ["Baseball", "Basketball", "Cricket", "Fantasy Sports", "Football", "Golf", "Hockey", "Rugby", "Running", "Soccer", "Swimming", "Tennis", "Volleyball", "Wilderness", "Wrestling"],
    "Technology": [],
    "True Crime": [],
    "TV & Film": ["After Shows", "Film History", "Film Interviews", "Film Reviews", "TV Reviews"],
}
# Subcategories in common use.
POPULAR = (
    "Language Learning",
    "Self-Improvement",
    "Entrepreneurship",
    "Investing",
    "Astronomy",
    "Physics",
    "Mental Health",
    "Nutrition",
    "Tech News",
    "Politics",
    "Fitness",
    "Medicine",
    "Parenting",
    "Video Games",
    "Automotive",
    "Football",
    "Basketball",
    "Christianity",
    "Buddhism",
    "Philosophy",
)
# Languages by code.
LANGUAGES = {
    "en": "English",
    "es": "Spanish",
    "fr": "French",
    "de": "German",
    "it": "Italian",
    "pt": "Portuguese",
    "nl": "Dutch",
    "sv": "Swedish",
    "no": "Norwegian",
    "da": "Danish",
    "ja": "Japanese",
    "ko": "Korean",
    "zh": "Chinese",
    "ru": "Russian",
    "ar": "Arabic",
    "hi": "Hindi",
    "tr": "Turkish",
    "pl": "Polish",
    "cs": "Czech",
    "hu": "Hungarian",
    "fi": "Finnish",
    "el": "Greek",
    "he": "Hebrew",
    "th": "Thai",
    "vi": "Vietnamese",
    "id": "Indonesian",
    "ms": "Malay",
    "fa": "Persian",
    "ur": "Urdu",
    "bn": "Bengali",
    "ta": "Tamil",
    "te": "Telugu",
    "ml": "Malayalam",
    "kn": "Kannada",
    "gu": "Gujarati",
    "pa": "Punjabi",
    "or": "Odia",
    "as": "Assamese",
    "ne": "Nepali",
    "si": "Sinhala",
    "my": "Burmese",
    "km": "Khmer",
    "lo": "Lao",
    "mn": "Mongolian",
    "ka": "Georgian",
    "am": "Amharic",
    "sw": "Swahili",
    "zu": "Zulu",
    "af": "Afrikaans",
    "xh": "Xhosa",
    "yo": "Yoruba",
    "ig": "Igbo",
    "ha": "Hausa",
    "so": "Somali",
    "rw": "Kinyarwanda",
    "lg": "Luganda",
    "ak": "Akan",
    "tw": "Twi",
    "ee": "Ewe",
    "fon": "Fon",
    "bam": "Bambara",
    "wol": "Wolof",
    "ful": "Fula",
    "zul": "Zulu",
    "xho": "Xhosa",
    "afr": "Afrikaans",
    "nbl": "Southern Ndebele",
    "nso": "Northern Sotho",
    "sot": "Southern Sotho",
    "tsn": "Tswana",
    "tso": "Tsonga",
    "ven": "Venda",
    "ssw": "Swati",
    "nno": "Norwegian Nynorsk",
    "nob": "Norwegian Bokmål",
    "sme": "Northern Sami",
    "smj": "Lule Sami",
    "sma": "Southern Sami",
    "smn": "Inari Sami",
    "sms": "Skolt Sami",
    "cnr": "Montenegrin",
    "srp": "Serbian",
    "hrv": "Croatian",
    "bos": "Bosnian",
    "slv": "Slovenian",
    "mkd": "Macedonian",
    "bul": "Bulgarian",
    "ron": "Romanian",
    "mol": "Moldovan",
    "alb": "Albanian",
    "kat": "Georgian",
    "arm": "Armenian",
    "aze": "Azerbaijani",
    "kaz": "Kazakh",
    "kir": "Kyrgyz",
    "uzb": "Uzbek",
    "tuk": "Turkmen",
    "taj": "Tajik",
    "mon": "Mongolian",
    "tib": "Tibetan",
    "nep": "Nepali",
    "ben": "Bengali",
    "asm": "Assamese",
    "ori": "Odia",
    "mar": "Marathi",
    "guj": "Gujarati",
    "pan": "Punjabi",
    "kan": "Kannada",
    "mal": "Malayalam",
    "tel": "Telugu",
    "tam": "Tamil",
    "sin": "Sinhala",
    "mya": "Burmese",
    "khm": "Khmer",
    "lao": "Lao",
    "tha": "Thai",
    "vie": "Vietnamese",
    "ind": "Indonesian",
    "msa": "Malay",
    "fil": "Filipino",
    "jav": "Javanese",
    "sun": "Sundanese",
    "mad": "Madurese",
    "min": "Minangkabau",
    "ace": "Acehnese",
    "ban": "Balinese",
    "bug": "Buginese",
    "mak": "Makassarese",
    "sas": "Sasak",
    "tet": "Tetum",
    "tim": "Timor",
    "bik": "Bikol",
    "ceb": "Cebuano",
    "hil": "Hiligaynon",
    "ilo": "Ilocano",
    "pam": "Kapampangan",
    "pag": "Pangasinan",
    "war": "Waray",
    "tgl": "Tagalog",
    "bis": "Bislama",
    "fij": "Fijian",
    "hif": "Fiji Hindi",
    "ton": "Tongan",
    "smo": "Samoan",
    "tah": "Tahitian",
    "haw": "Hawaiian",
    "mao": "Maori",
    "rar": "Rarotongan",
    "niu": "Niuean",
    "tkl": "Tokelauan",
    "tuv": "Tuvaluan",
    "gil": "Gilbertese",
    "mri": "Maori",
}
MAIN_OF = {sub: main for main, subs in CATEGORIES.items() for sub in subs}
CODE_OF = {name: code for code, name in LANGUAGES.items()}


def valid(category: str) -> bool:
    return category in CATEGORIES or category in MAIN_OF


def siblings(category: str) -> list[str]:
    """Subcategories of the same main category, itself included."""
    return CATEGORIES.get(MAIN_OF.get(category, category), [])


def search(query: str) -> list[str]:
    """Subcategories that hold the query, case apart, by name."""
    return sorted(s for s in MAIN_OF if query.lower() in s.lower())


def statistics() -> dict:
    return {"subcategories": len(MAIN_OF), "by_main": {main: len(subs) for main, subs in CATEGORIES.items()}}


def category_table(spark: SparkSession) -> DataFrame:
    """(main, sub), sub null where a main category has none."""
    return spark.createDataFrame([(m, s) for m, subs in CATEGORIES.items() for s in subs or [None]], "main string, sub string")


def _mapped(of: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), c)


def main_category(c: Column) -> Column:
    """The main category of a subcategory; any other value as it is."""
    return F.coalesce(_mapped(MAIN_OF, c), c)


def language_name(c: Column) -> Column:
    """The name of a language code; null where unknown."""
    return _mapped(LANGUAGES, c)
