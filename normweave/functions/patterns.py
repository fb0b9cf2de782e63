"""Pattern tables.  Fixed values: they decide which rows come out, in the order given.  Java and RE2 read them alike."""

W = r"[\p{L}\p{N}_]"
ID = rf"[A-Za-z_]{W}*"
DOTNUM = r"\d+(?:\.\d+)*"
NUM = r"\d+(?:\.\d+)?"
REST = r"[^,.\n]+"
S = r"[^.]+"

#: Section headers; group 1 is the number, group 2 the title.
HEADERS = [
    rf"^({DOTNUM})\s+(.+?)$",
    r"^([A-Z](?:\.\d+)*)\s+(.+?)$",
    r"^(Chapter\s+\d+)\s*[:-]?\s*(.+?)$",
    rf"^(Section\s+{DOTNUM})\s*[:-]?\s*(.+?)$",
]
#: Cross-references: pattern with the target in group 1, type of the target.
REFERENCES = [
    (rf"(?i)see\s+section\s+({DOTNUM})", "section"),
    (r"(?i)refers?\s+to\s+table\s+([\d.-]+)", "table"),
    (r"(?i)(?:as\s+)?shown\s+in\s+figure\s+([\d.-]+)", "figure"),
    (r"(?i)according\s+to\s+equation\s*\(?([\d.]+)\)?", "equation"),
    (rf"(?i)per\s+section\s+({DOTNUM})", "section"),
    (rf"(?i)in\s+accordance\s+with\s+({DOTNUM})", "section"),
    (rf"(?i)\(\s*see\s+({DOTNUM})\s*\)", "section"),
    (rf"(?i)section\s+({DOTNUM})\s+(?:provides|describes|specifies)", "section"),
]
#: Formulas on a line.
FORMULAS = [
    rf"{ID}\s*=\s*{REST}",
    rf"{ID}\s*[<>≤≥]\s*{REST}",
    rf"{ID}\s*\([^)]+\)\s*=\s*{REST}",
    r"\$[^$]+\$",
    rf"{NUM}\s*[×*]\s*{NUM}\s*=\s*{NUM}",
    rf"{W}+[²³]?\s*/\s*{W}+",
]
#: Definitions of variables: symbol, description and (only in the second) unit.
DEFINITIONS = [
    rf"(?im)where\s+({ID})\s+(?:is|=)\s+(?:the\s+)?({REST})",
    rf"(?im)({ID})\s*=\s*([^(]+)\s*\(([^)]+)\)",
    rf"(?im)let\s+({ID})\s+be\s+(?:the\s+)?({REST})",
    rf"(?im)({ID})\s*:\s*({REST})",
    rf"(?im)({ID})\s*\(([^)]+)\)\s*=",
]
#: Rules in a sentence: type, pattern, number of groups.
RULES = [
    ("conditional", rf"(?i)if\s+([^,]+),?\s+then\s+({S})", 2),
    ("conditional", rf"(?i)when\s+([^,]+),\s*({S})", 2),
    ("conditional", rf"(?i)where\s+([^,]+),\s*({S})\s+shall\s+be\s+({S})", 3),
    ("requirement", rf"(?i)({S})\s+(?:shall|must)\s+(?:be\s+)?({S})", 2),
    ("requirement", rf"(?i)it\s+is\s+required\s+that\s+({S})", 1),
    ("requirement", rf"(?i)({S})\s+is\s+mandatory", 1),
    ("constraint", rf"(?i)({S})\s+shall\s+not\s+exceed\s+({S})", 2),
    ("constraint", rf"(?i)maximum\s+({S})\s+is\s+({S})", 2),
    ("constraint", rf"(?i)minimum\s+({S})\s+is\s+({S})", 2),
    ("constraint", rf"(?i)([^≤<]+)\s*[≤<]\s*({S})", 2),
    ("constraint", rf"(?i)([^≥>]+)\s*[≥>]\s*({S})", 2),
    ("calculation", rf"(?i)({ID})\s*=\s*({S})", 2),
    ("calculation", rf"(?i)calculate\s+({S})\s+as\s+({S})", 2),
    ("calculation", rf"(?i)({S})\s+is\s+determined\s+by\s+({S})", 2),
    ("validation", rf"(?i)verify\s+that\s+({S})", 1),
    ("validation", rf"(?i)check\s+(?:whether|that)\s+({S})", 1),
    ("validation", rf"(?i)ensure\s+(?:that\s+)?({S})", 1),
    ("reference", rf"(?i)refer\s+to\s+({S})\s+for\s+({S})", 2),
    ("reference", rf"(?i)see\s+section\s+({S})", 1),
    ("reference", rf"(?i)in\s+accordance\s+with\s+({S})", 1),
]
RULE_TYPES = ["conditional", "requirement", "constraint", "calculation", "validation", "reference"]
#: Conditions: pattern, operator.
CONDITIONS = [
    (r"(?i)([^>]+)\s*>\s*([^,\s]+)", ">"),
    (r"(?i)([^≥]+)\s*≥\s*([^,\s]+)", ">="),
    (r"(?i)([^<]+)\s*<\s*([^,\s]+)", "<"),
    (r"(?i)([^≤]+)\s*≤\s*([^,\s]+)", "<="),
    (rf"(?i)({S})\s+equals?\s+([^,\s]+)", "=="),
    (rf"(?i)({S})\s+is\s+([^,\s]+)", "=="),
]
#: A signed number and the run of unit characters after it.
VALUE_UNIT = r"([+-]?\d+(?:\.\d+)?)\s*([A-Za-z°²³/*^-]+)?"
#: Quantities in text, first match wins: value, unit.
QUANTITIES = [r"([+-]?\d+(?:\.\d+)?)\s*([A-Za-z°²³*^-]+(?:\s*/\s*[A-Za-z°²³]+)*)", r"([+-]?\d+(?:\.\d+)?)\s*\(([^)]+)\)"]
CITATION = rf"Section\s+({DOTNUM})"
FUNCTION_NAMES = ["sin", "cos", "tan", "log", "ln", "exp", "sqrt", "max", "min"]
OPERATORS = ["!=", "*", "+", "-", "/", "<", "<=", "=", ">", ">=", "^", "~="]
#: Symbols and their plain forms, replaced in this order.
FORMULA_SYMBOLS = [("×", "*"), ("÷", "/"), ("≤", "<="), ("≥", ">="), ("≠", "!="), ("≈", "~="), ("²", "^2"), ("³", "^3"), ("√", "sqrt")]
EXPRESSION_SYMBOLS = [("×", "*"), ("÷", "/"), ("−", "-"), ("–", "-"), ("^", "**"), ("²", "**2"), ("³", "**3"), ("√", "sqrt")]
UNIT_SYMBOLS = [("²", "**2"), ("³", "**3"), ("°", "degree_")]
