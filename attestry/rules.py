"""Vocabularies as small tables. Each is an argument of the jobs that use it; `ord` settles ties (first declared wins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Words that acronyms leave out.
JOIN_WORDS = ("and", "of", "the", "for", "in", "on", "with", "a", "an", "or", "to")

# Labels of "Label: value" rows (pattern, field), in order.
LABELS = [
    (r"full\s*name|name in full", "name"),
    (r"preferred\s*name|nickname", "preferred_name"),
    (r"e-?mail|email address", "email"),
    (r"phone|mobile|telephone|phone number|contact number", "phone"),
    (r"linkedin|github|portfolio|website|profile url", "url"),
    (r"current location|location|address|city", "address"),
    (r"universit(?:y|ies)|school|institution", "education"),
    (r"department\s*/?\s*major|department|major|field of study", "department"),
    (r"class\s*/?\s*year standing|year standing|academic year|class", "year_standing"),
    (r"expected graduation|graduation", "graduation"),
    (r"degree level|degree", "degree"),
    (r"technical skills|skills|technologies", "skills"),
    (r"languages?", "language"),
    (r"nationality|citizenship", "nationality"),
    (r"date of birth|dob|birth date", "dob"),
    (r"sex|gender", "gender"),
    (r"place of birth", "place_of_birth"),
    (r"passport(?:\s*(?:no|number))?", "passport"),
    (r"student\s*id|employee\s*id|id\s*(?:no|number)|national id", "id"),
    (r"career goal|objective|career objective", "other"),
]

# Keywords of questions in English by the key of the fact they ask for, in order. Other languages are rows
# that the caller adds.
KEYWORDS = {
    "first_name": ["first name", "given name", "forename"],
    "middle_name": ["middle name", "second name"],
    "last_name": ["last name", "family name", "surname"],
    "name": ["full name", "your name", "name in full", "first and last", "name"],
    "email": ["email", "e-mail", "e mail", "mail"],
    "dial_code": ["country code", "dial code", "dialing code", "phone code", "area code"],
    "phone": ["mobile number", "phone number", "telephone", "phone", "mobile", "cellphone", "cell", "contact number"],
    "dob_year": ["year of birth", "birth year", "dob year"],
    "dob_month": ["month of birth", "birth month", "dob month"],
    "dob_day": ["day of birth", "birth day", "dob day"],
    "dob": ["date of birth", "birth date", "dob", "born"],
    "city": ["city", "town", "city of residence"],
    "state": ["state", "province", "region", "state/province"],
    "postal_code": ["postal code", "post code", "postcode", "zip", "zip code"],
    "country": ["country", "country of residence", "nation"],
    "address": ["address", "postal address", "residential address", "home address", "street address"],
    "nationality": ["nationality", "citizenship"],
    "gender": ["gender", "sex"],
    "id": ["passport number", "passport", "national id", "student id", "employee id", "id number", "identification number", "identification"],
    "url": ["linkedin", "github", "portfolio", "personal website", "website", "profile url"],
    "education": ["institution attended", "name of institution", "university", "college", "school attended", "alma mater", "which institution", "institution"],
    "language": ["languages spoken", "language spoken", "languages"],
    "years_experience": ["years of experience", "total experience", "work experience years"],
    "job_title": ["job title", "current title", "position title"],
    "employer": ["employer", "current employer", "company", "organization"],
    "department": ["field of study", "department", "major", "discipline", "programme of study", "program of study"],
    "year_standing": ["academic year", "year standing", "year of study", "current year", "tenure", "class standing", "level of study"],
    "skills": ["programming languages", "languages are you proficient", "technical skills", "skills", "technologies", "proficient in"],
    "passport": ["passport number", "passport no", "passport"],
    "place_of_birth": ["place of birth", "birth place", "born in"],
    "preferred_name": ["preferred name", "nickname", "known as", "goes by"],
    "graduation": ["expected graduation", "graduation date", "graduation year", "completion date"],
    "degree": ["degree level", "degree", "qualification level"],
}

# Labels of navigation controls by language: next, back, submit.
NAV_LABELS = {
    "en": (["next", "continue", "next step", "proceed"], ["back", "previous", "prev"], ["submit", "send", "finish", "done"]),
    "it": (["avanti", "continua", "prosegui"], ["indietro", "precedente"], ["invia", "inoltra", "fine"]),
    "es": (["siguiente", "continuar", "adelante"], ["atras", "anterior"], ["enviar", "finalizar"]),
    "fr": (["suivant", "continuer", "suite"], ["precedent", "retour"], ["envoyer", "soumettre", "terminer"]),
    "de": (["weiter", "nachste", "fortfahren"], ["zuruck", "vorherige"], ["absenden", "senden", "abschicken"]),
    "pt": (["proximo", "seguinte", "continuar", "avancar"], ["voltar", "anterior"], ["enviar", "concluir", "finalizar"]),
    "ar": (["التالي", "متابعة", "التالى"], ["السابق", "رجوع", "عودة"], ["إرسال", "ارسال", "إنهاء"]),
    "am": (["ቀጣይ", "ቀጥል", "ይቀጥሉ"], ["ተመለስ", "ኋላ", "የቀድሞ"], ["አስገባ", "ላክ", "ጨርስ"]),
    "zh": (["下一步", "下一页", "继续", "繼續"], ["上一步", "上一页", "返回"], ["提交", "发送", "發送", "完成"]),
    "hi": (["आगे", "अगला", "जारी रखें"], ["पीछे", "पिछला", "वापस"], ["जमा करें", "भेजें", "पूर्ण"]),
    "ru": (["далее", "продолжить", "вперед", "вперёд"], ["назад", "предыдущий"], ["отправить", "готово", "завершить"]),
    "sw": (["endelea", "ifuatayo", "mbele"], ["nyuma", "rudi", "iliyotangulia"], ["wasilisha", "tuma", "maliza"]),
}

# Words that ask for, or are found in, a document of a kind.
DOCUMENT_WORDS = {
    "cv": ["cv", "curriculum", "resume", "résumé"],
    "resume": ["cv", "curriculum", "resume", "résumé"],
    "transcript": ["transcript", "grade", "gpa", "marks", "academic record"],
    "passport": ["passport", "identity", "id card", "national id"],
    "portfolio": ["portfolio", "sample", "work sample"],
    "cover": ["cover letter", "motivation letter"],
    "certificate": ["certificate", "certification", "diploma", "degree"],
}


def keywords(spark: SparkSession) -> DataFrame:
    """(key, keyword, ord)."""
    rows = [(k, w) for k, words in KEYWORDS.items() for w in words]
    return spark.createDataFrame([(k, w, i) for i, (k, w) in enumerate(rows)], "key string, keyword string, ord int")


def nav_labels(spark: SparkSession) -> DataFrame:
    """(language, kind, label, ord): submit before next before back on ties, as declared."""
    order = (("submit", 2), ("next", 0), ("back", 1))
    rows = [(lang, kind, label) for lang, sets in NAV_LABELS.items() for kind, at in order for label in sets[at]]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "language string, kind string, label string, ord int")


def document_words(spark: SparkSession) -> DataFrame:
    """(key, word, ord): a label that holds the key or any of its words asks for all of them."""
    rows = [(k, w) for k, words in DOCUMENT_WORDS.items() for w in dict.fromkeys([k, *words])]
    return spark.createDataFrame([(k, w, i) for i, (k, w) in enumerate(rows)], "key string, word string, ord int")


def rule_tables(spark: SparkSession) -> DataFrame:
    """All vocabularies in one: (vocabulary, key, term, ord). Label rows hold patterns."""
    labels = spark.createDataFrame([("label", field, p, i) for i, (p, field) in enumerate(LABELS)], "vocabulary string, key string, term string, ord int")
    k = keywords(spark).selectExpr("'keyword' as vocabulary", "key", "keyword as term", "ord")
    n = nav_labels(spark).selectExpr("'navigation' as vocabulary", "concat(language, ' ', kind) as key", "label as term", "ord")
    d = document_words(spark).selectExpr("'document' as vocabulary", "key", "word as term", "ord")
    return labels.unionByName(k).unionByName(n).unionByName(d)
