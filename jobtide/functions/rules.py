"""Ordered keyword rules: first match wins, everything else gets a default.

A rule is ``(label, pattern)``, or ``(label, pattern, pattern)`` when both
patterns must occur.  A rule set becomes one CASE expression, so classifying is a plain
projection: no join, no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from itertools import chain
from operator import and_

from pyspark.sql import Column, functions as F

from .text import as_column, computed_once, normalize_posting_text

Rule = tuple[str, ...]


# Parts of a pattern whose letters are not text to be matched: character classes by name, quotes,
# numeric escapes and inline flags.
_NOT_TEXT = re.compile(r"\\[pPQENxuk]|\(\?[a-zA-Z-]+[:)]|\(\?<[A-Za-z]")


def _folded(pattern: str) -> str | None:
    """The pattern in lower case, escapes such as \\b left as they are; None where case means more than text."""
    if _NOT_TEXT.search(pattern):
        return None
    return re.sub(r"(?<!\\)[A-Z]+", lambda m: m[0].lower(), pattern)


def matches(x: Column, pattern: str, lowered: Column | None = None) -> Column:
    """Case-insensitive search, for accented letters too.

    Lower-casing the text once is several times cheaper than a case-insensitive
    pattern, which folds every character at every position it tries.  Patterns that
    cannot be lower-cased themselves are used as they are, with the flags for it.
    """
    folded = _folded(pattern)
    if folded is None:
        return x.rlike(f"(?iu){pattern}")
    return (F.lower(x) if lowered is None else lowered).rlike(folded)


def classify(x: Column | str, rules: Iterable[Rule], default: str) -> Column:
    """Label of the first rule whose patterns all occur in ``x``; null text gets the default.

    The text is lower-cased once for all rules.
    """
    x = as_column(x)
    rules = list(rules)
    if not rules:
        return F.lit(default)

    def decide(lowered: Column) -> Column:
        chosen = None
        for label, *patterns in rules:
            hit = reduce(and_, (matches(x, p, lowered) for p in patterns))
            chosen = F.when(hit, label) if chosen is None else chosen.when(hit, label)
        return chosen.otherwise(default)

    return computed_once(F.lower(x), decide)


def rules_for(rules: list[Rule], labels: Iterable[str]) -> list[Rule]:
    """The leading rules that decide whether one of the labels applies; the rules
    after the last of them cannot change that."""
    wanted = set(labels)
    last = max(i for i, (label, *_patterns) in enumerate(rules) if label in wanted)
    return rules[: last + 1]


def recode(x: Column | str, labels: Mapping[str, str], default: str | None = None) -> Column:
    """Exact lookup; what is not listed keeps its value, or gets ``default``."""
    x = as_column(x)
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(table, x), x if default is None else F.lit(default))


def contains_first(x: Column | str, fragments: Iterable[tuple[str, str]], default: Column | str) -> Column:
    """Label of the first literal fragment found in ``x``."""
    x = as_column(x)
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for fragment, label in fragments:
        chosen = chosen.when(x.contains(fragment), label)
    return chosen.otherwise(as_column(default))


# ---------------------------------------------------------------------------
# The K-12 position rules, in evaluation order.
# ---------------------------------------------------------------------------
TEACHING_WORDS = "Teacher|Instructor|Interventionist|English|Math|Library|Media|Language Arts|Science|Educator"
K12_POSITION_RULES: list[Rule] = [
    ("Paraprofessional", "Paraprofessional|Para|Paraeducator"),
    ("Substitute", "Sub|Substitute"),
    (
        "Support Services",
        "Counselor|Psychologist|Therapist|Pathologist|Occupational|Alternative Behavior Program"
        "|Audiologist|Lifeguard|Interpreter|Translator|Monitor|Safety Patrol|Social Worker"
        "|Technology Intern|Tutor|Instructional Facilitator|Resource Officer|Behavior|Occupational"
        "|Aide|Aid|Support",
    ),
    ("Part-Time Teacher", TEACHING_WORDS, r"Part[- ]?Time|Half[- ]?Time|\b1/[2-9]th\b|\b0?\.[1-9]\s*FTE\b"),
    ("Teacher", TEACHING_WORDS),
    (
        "Athletics",
        "Coach|Athletic|Sports|Track|Football|Basketball|Golf|Soccer|Wrestling|Cheer|BB|Volleyball|Aquatics|Skiing",
    ),
    ("Custodial/Maintenance", "Custodian|Custodial|Maintenance|Cleaner|Snow Removal|Facility|Electrician|HVAC"),
    ("Transportation", r"Bus Driver|Driver|Transportation|Route|\bBus\b|Mechanic|Bus Mechanic|Bus Monitor"),
    ("Administration", "Principal|Director|Coordinator|Administrator|Supervisor|Administrative"),
    ("Staff", "Secretary|Office Clerk|Office Manager|Desk Clerk|Aide"),
    ("Food Services", "Food|Cook|Nutrition|Cafeteria|Dishwasher"),
    ("Child Care", "Daycare|After School|Head Start"),
]
K12_POSITION_DEFAULT = "Other"

# ---------------------------------------------------------------------------
# The K-12 subject rules, in evaluation order (the two special
# education rules come first; later rules may be shadowed by earlier ones).
# ---------------------------------------------------------------------------
K12_SUBJECT_RULES: list[Rule] = [
    (
        "Special Education - Resource/Life Skills",
        r"\b(Resource (Teacher|Room)|Life Skills|Affective Needs|Daily Living Skills|Special Needs|\bPALS\b)\b",
    ),
    (
        "Special Education - General",
        r"\b(Special[- ]Education|Special Ed\.?\b|SPED|Exceptional Children|Deaf|Visually Impaired)\b",
    ),
    (
        "Technical Education",
        r"\b(Welding|Weld|CTE|Automotive|Auto(?!nomy)|Wood|Woods|Industrial Arts|Shop|Tech Ed|Technical Education)\b",
    ),
    ("Agriculture Education", r"\b(Agriculture|Ag Teacher|FFA|Vo[-/]?Ag)\b"),
    (
        "Computer Science Education",
        r"\b(Computer Science|Information Technology|\bIT\b|Technology Education(?! Teacher Assistant))\b",
    ),
    (
        "Early Childhood Education",
        r"\b(Early Childhood|Pre[- ]?K(?!indergarten)|Pre[- ]?school|Birth to age|Ages 3-5|Head Start)\b",
    ),
    (
        "Elementary Education",
        r"\b(Elementary|Kindergarten|1st|2nd|3rd|4th|5th|First|Second|Third|Fourth|Fifth|Grade [1-6])\b",
    ),
    (
        "English Language Arts Education",
        r"\b(English(?!\s+as\s+a\s+Second\s+Language|\s+Learner|\s+Language\s+Learner)|ELA"
        r"|Language Arts(?!\s*Coordinator)|(Literacy|Reading) Interventionist)\b",
    ),
    ("Family and Consumer Science", r"\b(Family and Consumer Sciences?|FCS|Home Economics)\b"),
    (
        "Language Education",
        r"\b(ESL|ELL|English as a Second Language|Bilingual|Spanish|French|Dual Language|World Language|Foreign Language)\b",
    ),
    ("Mathematics Education", r"\b(Mathematics|\bMath\b)\b"),
    ("Music Education", r"\b(Music|Orchestra|Band)\b"),
    (
        "Physical Education",
        r"\b(Physical Education|P\.?E\.?|PE\s*/\s*Health|Health\s*/\s*PE|Health and Physical Education|Phys\.?\s*Ed\.?)\b",
    ),
    ("Health Science", r"\b(Nurse Educator|Health Science)\b"),
    ("Science Education", r"\b(Science|Biology|Chemistry|Physics|Earth Science)\b"),
    ("Social Studies Education", r"\b(Social Studies|History|Geography|Civics|Political Science)\b"),
    ("Business and Economics", r"\b(Business|Economics|Econ)\b"),
    ("Substitute Teaching", r"\b(Substitute|Guest Teacher)\b"),
    ("Virtual Education", r"\b(Virtual|Online|Remote)\b"),
    ("Art Teacher", r"\b(Art Teacher|\bArt\b)\b"),
    ("STEM Teacher", r"\b(STEM)\b"),
    ("CTE Teacher", r"\b(Career and Technical Education|CTE Teacher|JROTC|ROTC|Military Instructor)\b"),
    ("Library Media", r"\b(Library|Librarian|Media Specialist)\b"),
    ("Gifted and Talented", r"\bGifted\b"),
]
K12_SUBJECT_DEFAULT = "Uncategorized"

# ---------------------------------------------------------------------------
# K-12 subject -> broad category (anything else is "Other").
# ---------------------------------------------------------------------------
K12_BROAD_CATEGORY = {
    "Agriculture Education": "CTE - Trades, Ag & Technical",
    "Art Teacher": "Art",
    "Business and Economics": "CTE - Business & Family Sciences",
    "Computer Science Education": "CTE - Business & Family Sciences",
    "Early Childhood Education": "Early Childhood",
    "Elementary Education": "Elementary",
    "English Language Arts Education": "English Language Arts Secondary",
    "Family and Consumer Science": "CTE - Business & Family Sciences",
    "Health Science": "CTE - Business & Family Sciences",
    "Language Education": "Language",
    "Mathematics Education": "Math",
    "Music Education": "Music",
    "Physical Education": "Physical Education",
    "STEM Teacher": "Science",
    "Science Education": "Science",
    "Social Studies Education": "Secondary Social Studies",
    "Special Education - General": "Special Education - General",
    "Special Education - Resource/Life Skills": "Special Education - Resource/Life Skills",
    "Technical Education": "CTE - Trades, Ag & Technical",
    "CTE Teacher": "CTE - Trades, Ag & Technical",
    "Uncategorized": "Other",
    "Virtual Education": "Other",
    "Library Media": "Library Media",
    "Gifted and Talented": "Gifted and Talented",
}
K12_BROAD_DEFAULT = "Other"

# Dashboard short labels, and the coarser grouping over them.
K12_SHORT_LABELS = {
    "English Language Arts Secondary": "Engl. LA",
    "Secondary Social Studies": "Soc. St.",
    "Special Education - General": "SpEd - General",
    "Special Education - Resource/Life Skills": "SpEd - Resource/LS",
    "CTE - Trades, Ag & Technical": "CTE - Trades/Ag",
    "CTE - Business & Family Sciences": "CTE - Biz/Family",
}
K12_COLLAPSED = {
    "Elementary": "Elementary & Early Childhood",
    "Early Childhood": "Elementary & Early Childhood",
    "SpEd - General": "Special Education",
    "SpEd - Resource/LS": "Special Education",
    "Math": "Core Academic",
    "Science": "Core Academic",
    "Engl. LA": "Core Academic",
    "Soc. St.": "Core Academic",
    "Language": "Core Academic",
    "CTE - Trades/Ag": "CTE",
    "CTE - Biz/Family": "CTE",
    "Music": "Arts & Enrichment",
    "Art": "Arts & Enrichment",
    "Physical Education": "Arts & Enrichment",
    "Library Media": "Arts & Enrichment",
    "Gifted and Talented": "Arts & Enrichment",
}

# ---------------------------------------------------------------------------
# The higher-ed job-type rules, in evaluation order.  The first
# label has two ways in; in the pooled one "Part-Time" needs a faculty word.
# ---------------------------------------------------------------------------
ADJUNCT_JOB_TYPE = "Adjunct/Part-Time Faculty"
FACULTY_JOB_TYPE = "Instructor/Teacher/Faculty"
FACULTY_WORDS = (
    "Instructor|Instructional|Teacher|Faculty|Professor|Lecturer|Post Doc|Subject Matter Expert|Librarian|Educator"
)
HE_JOB_TYPE_RULES: list[Rule] = [
    (ADJUNCT_JOB_TYPE, "Adjunct"),
    (ADJUNCT_JOB_TYPE, "Part[- ]?Time", "Faculty|Instructor|Professor|Lecturer|Teacher"),
    (FACULTY_JOB_TYPE, FACULTY_WORDS),
    (
        "Student Positions",
        "Student Worker|Student Position|Work Study|Students Only|Student Library Aid|Student Employment",
    ),
    ("Healthcare", "Nurse|Wellbeing|Health|Medicine|Medical Support Assistant"),
    ("Temporary Position", "Pooled Position|Temporary|Monthly Pooled"),
    (
        "Staff",
        "Hourly|Administrative Assistant|Administrative Associate|Secretary|Library Assistant"
        "|Office Assistant|Office Associate",
    ),
    (
        "Advising and Student Services",
        "Advisor|Advising|Enrollment Counselor|Financial Aid|Peer Tutor|Tribal Education Assistant",
    ),
    ("Culinary", "Chef|Cook|Baker|Dining|Culinary"),
    (
        "Professional",
        "Admissions|Coordinator|Registrar|Executive Assistant|Professional|Statistician|Proctor|Exec Assistant"
        "|Grant Writer|Graphic Designer|Negotiator|Botanist|College Relations|Controller|Database|Officer"
        "|Auditor|Web Site|Special Assistant|Retention Mentor|Data Analyst|Employee Relations Specialist"
        "|Finance Technician|Grant Support Specialist|Marketing & Comm Spec.|Program Specialist",
    ),
    (
        "Administration",
        r"\bDean\b|Vice President|Provost|Chief|Business Manager|Enrollment Specialist|Finance Technician"
        r"|HR Records Specialist",
    ),
    ("Coaching or Athletics", "coach|Athletic|Athletics"),
    ("Accounting/Finance", "Accountant|Receivable|Accounts"),
    ("Research & Science", "Research Associate|Laboratory Technician|Research Scientist"),
    (
        "Technical",
        "Control Specialist|Engineer|IT Support Technician|Information Security Analyst|Programmer Analyst"
        "|Network Specialist|Data Operation Engineer|Design Engineer|GIS Specialist",
    ),
    (
        "Maintenance & Service",
        "Maintenance|Technician|Facilities|Grounds|HVAC|Plumber|Carpenter|Logistics Handler",
    ),
    (
        "Support Services",
        "Safety|Security|Custodian|Laborer|Driver|Cleaner|Facilities|Grounds|Library Information Specialist"
        "|Museum Exhibit Specialist|Specialist, Student Services|Lifeguard|Resident Assistant",
    ),
    (
        "Management",
        r"Director|\bDirector\b|Manager|Supervisor|Assoc Director|Assoc Dir|Assist Dir|Asst Dir",
    ),
]
HE_JOB_TYPE_DEFAULT = "Other"

# ---------------------------------------------------------------------------
# The faculty subject rules, in evaluation order.
# ---------------------------------------------------------------------------
HE_CATEGORY_RULES: list[Rule] = [
    ("Legal", "Law|Legal|College of Law"),
    ("Criminal Justice", "Criminal Justice"),
    ("Extension/Outreach", r"Extension Educator|Extension Specialist|\bExtension\b"),
    ("CTE - Trades & Engineering", r"\bAgricultural Communications\b|Agricultural"),
    ("Math", "Math"),
    ("Humanities", "Philosophy|English|Communication( Studies)?|Literature|Mass Communication"),
    (
        "CTE - Business & Computing",
        r"\bComputer Science\b|Computer|Zoology|Information Technology|Computing",
    ),
    (
        "Science",
        r"Chemistry|Biology|Physics|Astronomy|\bLab\b|Laboratory|Geology|Science|Artificial Intelligence",
    ),
    ("History", "History"),
    ("CTE - Business & Computing", r"Business|Accounting|Finance|Economics|\bEcon\b"),
    ("Physical Education", "Physical|Outdoor Activity|Athletic Train(er|ing)|Kinesiology|Strength"),
    (
        "CTE - Health Sciences",
        "Health Technology|Nursing|Dental Hygiene|EMS|Medical|Medicine|Nutritional|Nutrition|Pharmacy",
    ),
    ("Culinary/Hospitality", "Culinary|Hospitality|Tourism"),
    (
        "CTE - Trades & Engineering",
        "Technology|Equine|Industrial|Electrical|Instrumentation|CDL|Massage|Maintenance|Manufacturing"
        "|Powerline|Substation|Construction|Diesel|Heavy Equipment|Supply Chain|Machine Tool|Welding"
        "|Mechanical|Engineering|Engineer|Energy|Printmaking",
    ),
    ("The Arts", r"\bArt\b|Graphic Design|Theater|Theatre|Acting|Music|Ceramics"),
    ("Human Services", "Human Services|Family"),
    ("Social Science", "Psychology|Anthropology|Sociology|Politics|Behavior|Social Work"),
    ("Language", "Spanish|Foreign Language|World Language|French|German"),
    ("Education", "Education|Curriculum|Educational|Early Childhood|Preschool"),
    ("Library", "library|librarian"),
]
HE_CATEGORY_DEFAULT = "Uncategorized"

# Appointment labels of the dashboard table.  Here a bare
# "Part-Time" is enough, unlike in the job-type rules above.
ADJUNCT_APPOINTMENT = "Adjunct/part-time faculty"
FACULTY_APPOINTMENT = "Faculty/instructor (non-adjunct)"
OTHER_APPOINTMENT = "Other / not faculty"
HE_APPOINTMENT_RULES: list[Rule] = [
    (ADJUNCT_APPOINTMENT, "Adjunct|Part[- ]?Time"),
    (FACULTY_APPOINTMENT, FACULTY_WORDS),
]
HE_APPOINTMENT_OF_JOB_TYPE = {
    FACULTY_JOB_TYPE: FACULTY_APPOINTMENT,
    ADJUNCT_JOB_TYPE: ADJUNCT_APPOINTMENT,
}

# Faculty category -> coarser dashboard grouping.
HE_COLLAPSED = {
    "CTE - Trades & Engineering": "CTE / Career-Technical",
    "CTE - Health Sciences": "CTE / Career-Technical",
    "CTE - Business & Computing": "CTE / Career-Technical",
    "Culinary/Hospitality": "CTE / Career-Technical",
    "Science": "STEM",
    "Math": "STEM",
    "Humanities": "Humanities & Social Sciences",
    "Social Science": "Humanities & Social Sciences",
    "History": "Humanities & Social Sciences",
    "Language": "Humanities & Social Sciences",
    "Criminal Justice": "Humanities & Social Sciences",
    "Legal": "Humanities & Social Sciences",
    "Human Services": "Humanities & Social Sciences",
    "Education": "Humanities & Social Sciences",
    "The Arts": "Arts & Physical Education",
    "Physical Education": "Arts & Physical Education",
    "Extension/Outreach": "Extension/Outreach & Library",
    "Library": "Extension/Outreach & Library",
}

# Locations on a shared board that name another institution, and
# the department that is an institution of its own.
SHARED_BOARD_LOCATIONS = [
    ("1205 E Broadway St", "Missoula College"),
    ("Helena, MT", "Helena College"),
    ("Dillon, MT", "University of Montana Western"),
]
INSTITUTION_DEPARTMENTS = ("Highlands College",)


def k12_position(title: Column | str, normalised: bool = False) -> Column:
    """``normalised`` says that the text went through ``normalize_posting_text`` already."""
    title = as_column(title) if normalised else normalize_posting_text(title)
    return classify(title, K12_POSITION_RULES, K12_POSITION_DEFAULT)


def k12_subject(title: Column | str, normalised: bool = False) -> Column:
    title = as_column(title) if normalised else normalize_posting_text(title)
    return classify(title, K12_SUBJECT_RULES, K12_SUBJECT_DEFAULT)


def k12_broad_category(category: Column | str) -> Column:
    return recode(category, K12_BROAD_CATEGORY, K12_BROAD_DEFAULT)


def he_job_type(title: Column | str) -> Column:
    return classify(title, HE_JOB_TYPE_RULES, HE_JOB_TYPE_DEFAULT)


def he_category(title: Column | str) -> Column:
    return classify(title, HE_CATEGORY_RULES, HE_CATEGORY_DEFAULT)


def he_appointment(title: Column | str) -> Column:
    return classify(title, HE_APPOINTMENT_RULES, OTHER_APPOINTMENT)


def location_institution(location: Column | str, default: Column | str) -> Column:
    return contains_first(location, SHARED_BOARD_LOCATIONS, default)


def department_institution(department: Column | str, default: Column | str) -> Column:
    """The department itself when it is an institution of its own, else the board's owner."""
    department = as_column(department)
    return F.when(department.isin(*INSTITUTION_DEPARTMENTS), department).otherwise(as_column(default))
