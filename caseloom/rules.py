"""Fixed values of the rule engine: patterns, lexicons, weights. Each is a parameter of the operators that use it."""

from __future__ import annotations

from dataclasses import dataclass, field

# Text patterns, case-insensitive unless said otherwise. They are written so that Java's and RE2's
# engines read them alike.
SECTION = r"(?:Section|Sec\.?|u/?s\.?|under)\s+(?:\d+[A-Za-z]?(?:\s*[,&/]\s*\d+[A-Za-z]?)*)(?:\s*(?:IPC|CrPC|CPC|IEA|Evidence Act|Code))?"
# The second code ends within twenty characters of the first.
SECTION_INLINE = r"(\d{2,3})\s*(?:IPC|CrPC|CPC)(\s{0,17}(?:IPC|CPC|IEA)|\s{0,16}CrPC)"
SECTION_INLINE_INTENT = r"(\d{2,3})\s*(IPC|CrPC|CPC|IEA)"
ACT = (
    r"\b((?:Indian\s+(?:Penal\s+Code|Evidence\s+Act|Succession\s+Act|Contract\s+Act|Stamp\s+Act|Trusts\s+Act|Partnership\s+Act|Arbitration\s*(?:and\s*)?Conciliation\s*Act)"
    r"|Code\s+of\s+(?:Criminal|Civil)\s+Procedure|Constitution\s+of\s+India|Companies\s+Act|Information\s+Technology\s+Act|National\s+Investigation\s+Agency\s*Act"
    r"|Prevention\s+of\s+Corruption\s+Act|Prevention\s+of\s+Money\s+Laundering\s+Act|Protection\s+of\s+Children\s+from\s+Sexual\s+Offences\s+Act"
    r"|(?:[A-Z][\w\s]{2,39}?)\s+Act\s*,?\s*\d{4}))\b"
)
ACT_LEAD = r"^(?:\s*(?:and|or|the|under|of|by|for|with|from)\s+)+"
ACT_BARRED = r"\b(?:under|section|article|order)\b"
PETITIONER = r"(?:petitioner|appellant|complainant|plaintiff)\s*[:=\-—]?\s*([^\n,]+?)(?:\s+(?:versus|vs\.?|v\.|against|Respondent)|\s*\z)"
RESPONDENT = r"(?:respondent|accused|defendant|reverspondent)\s*[:=\-—]?\s*([^\n,]+?)(?:\s+(?:versus|vs\.?|v\.|against|Appellant|Petitioner)|\s*\z)"
VERSUS = r"(?:[Nn]o\.\s*\d+.*?)?\s*\n{1,2}([^\n]+?)\s*\n?\s*(?:versus|vs\.?|v\.)\s*\n?\s*([^\n]+)(?:\n\s*(?:CORAM|Date:|J\.|JJ|Bench|Hon|Order|FIR|AIR|SCC|SCR)|\n?\z)"
PETITIONER_TAIL = r"\s*\.+\s*(?:Appellant|Petitioner|Complainant|Plaintiff)\s*$"
RESPONDENT_TAIL = r"\s*\.+\s*(?:Respondent|Accused|Defendant)\s*$"
COURT = (
    r"(Supreme Court of India|Supreme Court|(?:\w+\s+)?High Court of\s+\w+|(?:\w+\s+)?High Court|District Court|District & Sessions Court|Sessions Court|Family Court"
    r"|Consumer\s+(?:Disputes\s+Redressal\s+)?Commission|National\s+Green\s+Tribunal|Central\s+Administrative\s+Tribunal|NCLT|NCLAT)"
)
COURT_LADDER = (
    ("supreme court", "Supreme Court"), ("high court", "High Court"), ("district", "District Court"), ("sessions", "District Court"), ("tribunal", "Tribunal"),
    ("nclt", "Tribunal"), ("nclat", "Tribunal"), ("commission", "Commission"), ("family court", "Family Court"),
)
CASE_TYPES = (
    ("constitutional", r"\b(constitutional\s+(?:validity|challenge|bench)|writ\s+petition|Article\s+32|Article\s+226|Article\s+21|Article\s+14|Article\s+19|fundamental\s+right|basic\s+structure|judicial\s+review)"),
    ("criminal", r"\b(criminal\s+(?:appeal|petition|writ|reference|review|revision|complaint|case|prosecution|trial)|FIR|chargesheet|charge\s+sheet|offence|accused|IPC|bail|anticipatory\s+bail|cognizable|non[- ]bailable|sessions\s+case|murder|rape|theft|cheating|Section\s+302|Section\s+420|Section\s+307|Section\s+376|Section\s+498A|Section\s+138)"),
    ("civil", r"\b(civil\s+(?:appeal|suit|petition|writ|revision)|decree|injunction|specific\s+performance|damages|partition|eviction|tenant|landlord|property\s+dispute|title\s+suit)"),
    ("tax", r"\b(income\s+tax|goods?\s+and\s+services?\s+tax|GST|central\s+excise|customs\s+duty|tax\s+(?:appeal|tribunal)|income\s+tax\s+appellate\s+tribunal|ITAT)"),
    ("labour", r"\b(labour\s+(?:court|dispute|tribunal)|industrial\s+dispute|workman|employer|termination\s+of\s+service|retrenchment|minimum\s+wages?|employees['']?\s+provident\s+fund)"),
)
#: (weight, pattern) of signals in a sentence.
FACT_SIGNALS = (
    (2.0, r"deceased|accused|victim|injured"), (1.5, r"\b\d{1,2}\s*(?:AM|PM|a\.?m\.?|p\.?m\.?)\b"), (1.0, r"\b(FIR|complaint|report|statement)\b"),
    (1.0, r"\b(post.?mortem|medical|injury|weapon)\b"), (0.8, r"\b(witness|testified|deposed|evidence)\b"), (-1.0, r"\b(this\s+(?:appeal|petition|case)\s+(?:is|was|comes))\b"),
)
RELIEF = r"(?:prayer|relief\s+sought|sought\s+relief|it\s+is\s+(?:hereby|respectfully)\s+(?:prayed|submitted)|petitioner\s+prays|prays?\s+(?:that|for))\s*[:.\-—]?\s*(.+?)(?:\n{2,}|Given\s+under|Dated\s*|Signature|\z)"
ISSUE = r"(?:issue|question)\s+(?:is|arises|before\s+this\s+(?:Court|bench))?\s*[:.\-—]?\s*(.+?)(?:\n{2,}|It\s+is|The\s+|Held\s*[:.]|\?)"
#: Case-sensitive.
WHETHER = r"(Whether\s+.+?\?|[Tt]he\s+(?:main|principal|key)\s+(?:issue|question)\s+(?:is|was|arises)\s+(?:that\s+)?(?:.+?)(?:\n\n|\.+\s|Held))"
CARD_SECTION = r"Section\s+(?:\d+[A-Z]?(?:\s*(?:IPC|CrPC|CPC))?)?"

#: Characters, letters in either case, that every match of a pattern begins with: one test of a character goes before the pattern's alternatives.
LEADS = {
    SECTION: "su", ACT: "a-z", PETITIONER: "pac", RESPONDENT: "rad", CASE_TYPES[0][1]: "cwafbj", CASE_TYPES[1][1]: "cfoaibnsmrt", CASE_TYPES[2][1]: "cdisptel", CASE_TYPES[3][1]: "igct", CASE_TYPES[4][1]: "liwetrm",
    RELIEF: "prsi", ISSUE: "iq", WHETHER: "WTt", VERSUS: r"n\s",
}
#: Words of which every match of a pattern has one, in whatever case: texts without them are not searched.
NEEDS = {
    SECTION_INLINE: ("pc",), SECTION_INLINE_INTENT: ("pc", "iea"), ACT: ("act", "code", "constitution"), VERSUS: ("versus", "vs", "v."),
    COURT: ("supreme court", "high court", "district", "sessions court", "family court", "commission", "tribunal", "nclt", "nclat"),
    CASE_TYPES[0][1]: ("constitutional", "writ", "article", "fundamental", "basic", "judicial"), CASE_TYPES[2][1]: ("civil", "decree", "injunction", "specific", "damages", "partition", "eviction", "tenant", "landlord", "property", "title"),
    CASE_TYPES[4][1]: ("labour", "industrial", "workman", "employer", "termination", "retrenchment", "wage", "provident"), PETITIONER: ("petitioner", "appellant", "complainant", "plaintiff"), RESPONDENT: ("respondent", "accused", "defendant"),
    CASE_TYPES[3][1]: ("tax", "gst", "excise", "customs", "itat"), RELIEF: ("pray", "relief", "submitted"), ISSUE: ("issue", "question"),
}

# Patterns of judgment pages.
PAGE_COURT = (r"(?:Court|Reported in)\s*:\s*(.+?)(?:\n|\z)", r"(Supreme Court of India|[\w\s]+High Court|[\w\s]+Bench)")
PAGE_DATE = (r"Date\s*:\s*(.+?)(?:\n|\z)", r"Dated\s*:\s*(.+?)(?:\n|\z)")
PAGE_BENCH = (r"(?:Bench|Coram)\s*:\s*(.+?)(?:\n{2}|\z)", r"Before\s*:\s*(.+?)(?:\n{2}|\z)")
#: Case-sensitive.
CITATIONS = (r"\bAIR\s+\d{4}\s+\w+\s+\d+\b", r"\(\d{4}\)\s+\d+\s+SCC\s+\d+", r"\[\d{4}\][\w\s\.]+\bSCR\b[\w\s\d\.]*", r"\b\d{4}\s+Cr[Ll]?J\s+\d+\b")
PAGE_SECTIONS = (r"(?:Article|Section|Section[s]?|Clause|Order)\s+\d+[A-Za-z]?(?:\(\d+\))?(?:\([A-Za-z]\))?(?:\s+of\s+[\w\s,]+?)?(?:\s*Act)?(?:\s*,\s*\d{4})?", r"[\w\s]+Act\s*,?\s*\d{4}")
DOC_LINK = r"/doc/(\d+)/?"
SITE = "https://indiankanoon.org"

# Argument graph.
NODE_STYLE = (("CLAIM", "#1B2A4A", "rectangle"), ("EVIDENCE", "#374151", "ellipse"), ("STATUTE", "#065F46", "diamond"), ("PRECEDENT", "#92400E", "hexagon"), ("ISSUE", "#1E3A5F", "round-rectangle"))
OTHER_STYLE = ("#666666", "rectangle")

# Outcome scoring.
COMPONENTS = ("Precedent Alignment", "Statutory Strength", "Argument Completeness", "Case Complexity", "Court Level")
WEIGHTS = (0.35, 0.25, 0.20, 0.10, 0.10)
PROB_MIN, PROB_MAX = 0.05, 0.95
BANDS = ((0.7, "Favorable", "green"), (0.5, "Uncertain", "amber"))
LOW_BAND = ("Unfavorable", "red")
ADVICE = ("The case appears favorable for the petitioner.", "The outcome is uncertain — success depends on how the court weighs key issues.", "The case faces significant headwinds — the petitioner's position is weak.")

# What-if.
QUALITY = (("weak", -0.05), ("moderate", 0.0), ("strong", 0.05))
JURISDICTION = (("same", 0.0, ""), ("high", 0.03, "High Court"), ("supreme", -0.08, "Supreme Court"), ("district", 0.08, "District Court"))
SIMILARITY = (("low", 0.01), ("medium", 0.025), ("high", 0.045))


@dataclass(frozen=True)
class Rules:
    """The patterns of the extraction; replace some for another domain."""

    section: str = SECTION
    section_inline: str = SECTION_INLINE
    act: str = ACT
    versus: str = VERSUS
    petitioner: str = PETITIONER
    respondent: str = RESPONDENT
    court: str = COURT
    court_ladder: tuple = COURT_LADDER
    case_types: tuple = CASE_TYPES
    fact_signals: tuple = FACT_SIGNALS
    relief: str = RELIEF
    issue: str = ISSUE
    whether: str = WHETHER
    max_facts: int = 8
    max_issues: int = 5
    flags: str = field(default="(?iU)")


LEGAL = Rules()
