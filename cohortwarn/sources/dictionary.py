"""Column names of the school data model."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Source column name -> name used by the plans in this package.
SOURCE_COLUMNS = {
    "slumpkod": "student_id",
    "kurs": "course",
    "betyg": "grade",
    "Läsår": "school_year",
    "Lektionstid": "lesson_time",
    "Frånvarotid": "absence_time",
    "Matematik": "math_score",
    "Engelska totalt": "english_total",
    "Svenska ordkedjor Stanine": "word_chains",
    "Svenska bokstavskedjor Stanine": "letter_chains",
    "Svenska meningskedjor Stanine": "sentence_chains",
    "Svenska rättstavning": "spelling",
    "Svenska diktamen Stanine": "dictation",
    "Engelska Vocabulary": "english_vocabulary",
    "Engelska Grammar": "english_grammar",
    "Engelska Reading": "english_reading",
    "datum": "snapshot_date",
    "tardiness_breakdown_missing": "missing",
    "tardiness_breakdown_on_time": "on_time",
    "tardiness_breakdown_late": "late",
    "Totalt betyg NP": "national_grade",
}

# Source table name -> name used by the plans in this package.
SOURCE_TABLES = {
    "elever": "students",
    "betyg": "grades",
    "franvaro": "absence",
    "diagnoser": "diagnostics",
    "canvas": "activity",
    "nationella_prov": "national_tests",
}

# Variable name -> name shown in coverage reports.
VARIABLE_LABELS = {
    "word_chains": "Swedish word chains",
    "sentence_chains": "Swedish sentence chains",
    "letter_chains": "Swedish letter chains",
    "spelling": "Swedish spelling",
    "dictation": "Swedish dictation",
    "grade": "Grade",
    "absence_time": "Absence",
    "english_vocabulary": "English Vocabulary",
    "english_grammar": "English Grammar",
    "english_reading": "English Reading",
    "english_total": "English total",
    "math_score": "Math diagnosis",
    "on_time_factor": "On time factor",
    "missing_factor": "Missing factor",
    "participation_factor": "Participation factor",
    "page_view_factor": "Page view factor",
    "late_factor": "Late factor",
}


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename the source columns that are present; leave all others."""
    return df.withColumnsRenamed({k: v for k, v in SOURCE_COLUMNS.items() if k in df.columns})
