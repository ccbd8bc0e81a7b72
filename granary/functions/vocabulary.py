"""Vocabularies that annotations and reports are checked against."""

# Fixed values, all of this file.

SPECIALTIES = (
    "general_medicine", "emergency_medicine", "critical_care", "infectious_disease", "cardiology", "neurology", "oncology", "endocrinology",
    "gastroenterology", "nephrology", "pulmonology", "rheumatology", "hematology", "dermatology", "psychiatry", "obstetrics", "gynecology",
    "pediatrics", "geriatrics", "surgery_general", "orthopedics", "urology", "ophthalmology", "ent", "radiology", "pathology", "anesthesiology",
    "public_health", "family_medicine", "unspecified",
)
LEVELS_OF_CARE = (
    "community", "prehospital", "primary", "emergency", "secondary", "tertiary", "unspecified",
)
SEVERITIES = (
    "routine", "urgent", "emergent", "life_threatening", "unspecified",
)
QUESTION_TYPES = (
    "triage", "diagnosis", "management", "follow_up", "prevention", "screening", "interpretation", "pharmacology", "ethics", "other",
)
AGE_GROUPS = (
    "neonate", "infant", "child", "adolescent", "adult", "elderly", "mixed", "unspecified",
)
GEOGRAPHY_ALIASES = ("unspecified", "n/a", "none", "null", "not specified")
GEOGRAPHY_BINS = ("americas", "europe", "africa", "asia", "oceania", "global", "other", "unspecified")
CRITERIA = (
    "Question comprehension",
    "Logical reasoning",
    "Relevance & completeness",
    "Harmlessness",
    "Fairness",
    "Contextual awareness",
    "Communication",
    "Clarity",
    "Alignment with guidelines",
)
#: Places by name; the order matters where one name is part of another.
CONTINENT_OF = {
    "united states": "americas",
    "us": "americas",
    "usa": "americas",
    "canada": "americas",
    "mexico": "americas",
    "brazil": "americas",
    "argentina": "americas",
    "chile": "americas",
    "peru": "americas",
    "colombia": "americas",
    "venezuela": "americas",
    "bolivia": "americas",
    "ecuador": "americas",
    "cuba": "americas",
    "haiti": "americas",
    "dominican republic": "americas",
    "jamaica": "americas",
    "north america": "americas",
    "south america": "americas",
    "latin america": "americas",
    "caribbean": "americas",
    "united kingdom": "europe",
    "uk": "europe",
    "england": "europe",
    "scotland": "europe",
    "wales": "europe",
    "ireland": "europe",
    "france": "europe",
    "germany": "europe",
    "italy": "europe",
    "spain": "europe",
    "portugal": "europe",
    "netherlands": "europe",
    "belgium": "europe",
    "switzerland": "europe",
    "austria": "europe",
    "sweden": "europe",
    "norway": "europe",
    "denmark": "europe",
    "finland": "europe",
    "poland": "europe",
    "greece": "europe",
    "russia": "europe",
    "ukraine": "europe",
    "romania": "europe",
    "czech republic": "europe",
    "hungary": "europe",
    "europe": "europe",
    "nigeria": "africa",
    "egypt": "africa",
    "south africa": "africa",
    "kenya": "africa",
    "ethiopia": "africa",
    "ghana": "africa",
    "uganda": "africa",
    "tanzania": "africa",
    "morocco": "africa",
    "algeria": "africa",
    "sudan": "africa",
    "zimbabwe": "africa",
    "senegal": "africa",
    "rwanda": "africa",
    "cameroon": "africa",
    "malawi": "africa",
    "mozambique": "africa",
    "zambia": "africa",
    "angola": "africa",
    "ivory coast": "africa",
    "cote d'ivoire": "africa",
    "democratic republic of congo": "africa",
    "drc": "africa",
    "africa": "africa",
    "sub-saharan africa": "africa",
    "china": "asia",
    "india": "asia",
    "japan": "asia",
    "south korea": "asia",
    "north korea": "asia",
    "thailand": "asia",
    "vietnam": "asia",
    "indonesia": "asia",
    "philippines": "asia",
    "malaysia": "asia",
    "singapore": "asia",
    "pakistan": "asia",
    "bangladesh": "asia",
    "sri lanka": "asia",
    "nepal": "asia",
    "myanmar": "asia",
    "cambodia": "asia",
    "laos": "asia",
    "mongolia": "asia",
    "turkey": "asia",
    "iran": "asia",
    "iraq": "asia",
    "israel": "asia",
    "saudi arabia": "asia",
    "united arab emirates": "asia",
    "uae": "asia",
    "jordan": "asia",
    "lebanon": "asia",
    "syria": "asia",
    "asia": "asia",
    "middle east": "asia",
    "southeast asia": "asia",
    "south asia": "asia",
    "east asia": "asia",
    "australia": "oceania",
    "new zealand": "oceania",
    "fiji": "oceania",
    "papua new guinea": "oceania",
    "oceania": "oceania",
    "global": "global",
    "worldwide": "global",
    "international": "global",
}
