"""Word lists, patterns, columns and messages of the data contract."""

# Fixed values of the contract, in natural order.
PLACEHOLDERS = ("0", "0.0", "-", "--", "---", "#REF!", "#VALUE!", "#N/A", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!", "None", "null", "N/A", "NA")
TEXT_PLACEHOLDERS = ("0", "0.0", "-", "--", "---", "#REF!", "#VALUE!", "#N/A", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!", "None", "null", "N/A", "NA")
AUDIT_PHRASES = (
    "strategic fit", "customer awarded", "package complete", "priority grade", "current material", "feasibility",
    "assessment", "evaluation", "checklist", "yes/no", "approved", "question",
)
STOP_WORDS = ("total", "subtotal", "notes", "approved", "revision", "revisions", "quote revision")
IGNORED_SHEETS = (
    "summary", "cover", "toc", "terms", "notes", "lookup", "instructions", "data", "master", "template",
    "job values vs quote",
)
TARGET_SHEETS = ("mpc", "qinfo", "quote info", "quoteinfo", "q-info", "quote_info")
# Fixed values of the contract: how closely a sheet's title names its kind (pattern, points), the titles
# that are the name itself, and the titles of numbered sheets.
MPC_TIERS = (
    (r"^mpc$", 1000), (r"^mpc[-_ ]?(?:quote|rfq|pricing|master)", 800), (r"^mpc[-_ ]*[0-9]+$", 400),
    (r"^mpc\b|^mpc[-_ ]", 300), (r"\bmpc\b", 200), (r"mpc", 100),
)
QINFO_TIERS = (
    (r"^(?:qinfo|quote info|quoteinfo|q-info|quote_info)$", 1000), (r"^(?:q[-_ ]?info|quote[-_ ]?info)\b", 500),
    (r"\b(?:qinfo|quote info|quoteinfo|q-info)\b", 300), (r"qinfo|quote info|quoteinfo", 100),
)
MPC_NAMES = ("mpc", "mpc quote", "mpc quotes", "mpc_quote", "mpc-quote", "mpc rfq")
QINFO_NAMES = ("qinfo", "quote info", "quoteinfo", "q-info", "quote_info")
MPC_NUMBERED = r"(?i)\b(?:item|mpc|part)[-_ ]*[0-9]+\b"
QINFO_NUMBERED = r"(?i)\b(?:item|qinfo|quote\s*info|part)[-_ ]*[0-9]+\b"
TAB_NUMBER = r"(?i)\b(?:item|mpc|qinfo|quote\s*info|part)[-_ ]*([0-9]+)\b"
#: What a sheet that gives cycle times mentions, in its first 60 rows and 50 columns.
CYCLE_MENTIONS = ("cycle time", "cycle sec", "cycle (sec)", "c/t", "sec/shot", "molding cycle")
TOKEN_STOP_WORDS = ("dwg", "drawing", "rev", "revision", "part", "item")
RESIN_WORDS = (
    "pa", "gf", "pp", "bk", "nylon", "resin", "poly", "schul", "ziam", "griv", "abs", "pom", "pbt", "pc", "tpe",
    "compound", "delrin", "celcon", "dupont", "basf", "sabic", "covestro",
)
DESCRIPTION_WORDS = (
    "bracket", "spring", "cover", "socket", "ball", "motor", "side", "housing", "bushing", "assembly", "bobbin",
    "schulamid", "ziamid", "grivory", "pa66", "gf30",
)
EXPORT_COLUMNS = (
    "source_file", "quote_id", "quote_item_number", "part_number", "description", "material", "cycle_time_sec",
    "ops_labour", "labour_rate", "weight_g", "annual_volume", "confidence", "quote_num_coord", "part_num_coord",
    "description_coord", "material_coord", "cycle_time_coord", "ops_labour_coord", "labour_rate_coord",
    "weight_g_coord", "annual_volume_coord", "warnings",
)
ANCHORS = {
    "quote": ("quote #", "quote number", "quote id", "quote no", "quote no.", "rfq #", "quote ref"),
    "part_number": ("part number", "part no", "part #", "p/n", "customer part", "customer p/n"),
    "cycle_time": (
        "cycle time", "cycle time (sec)", "cycle time (s)", "cycle sec", "c/t", "sec/shot", "molding cycle",
        "cycle (sec)", "est cycle time",
    ),
    "description": (
        "part description", "part desc", "part desc.", "part discription", "description", "discription", "desc", "desc.",
    ),
    "material": ("resin grade", "material grade", "grade", "material", "resin", "material description", "raw material"),
    "ops_labour": ("#ops", "# ops", "ops", "labour", "labor", "operators", "operator", "# operators"),
    "weight_g": ("weight (g)", "weight(g)", "part weight (g)", "part wt (g)", "part weight", "weight", "wt (g)"),
    "annual_volume": (
        "ann. volume (eau)", "ann. volume", "annual volume (eau)", "annual volume", "volume (eau)", "volume", "eau",
        "ann volume",
    ),
}
DRAWING_ANCHORS = ("drawing number", "drawing no", "drawing #", "drawing", "dwg number", "dwg no", "dwg #", "dwg")
RATE_ANCHORS = (
    "rate $cad/hr", "rate cad/hr", "rate $/hr", "rate $cad / hr", "$cad/hr", "cad/hr", "labour rate", "labor rate",
)
# Fixed values of the contract: what a label of a rate holds, and what stands below a bare "labour" that is one.
RATE_PARTS = ("rate $cad/hr", "rate cad/hr", "$cad/hr", "rate $/hr", "rate $cad / hr", "labour rate", "labor rate")
RATE_BELOW = ("rate", "$cad", "cad/hr")
GRADE_ANCHORS = ("resin grade", "material grade", "grade")
ITEM_LABELS = (
    "item #", "item#", "item no", "item no.", "item number", "line item", "line #", "line#", "item", "pos #", "pos#", "pos",
)
#: What the first column of a row that numbers the columns may hold.
INDEX_LABELS = ("col #", "col no", "col", "column", "no.", "no", "#")
#: Error values beside a label of a cycle time: no value, but its place.
ERRORS = ("#N/A", "#VALUE!", "#REF!")
OFFSETS = ((0, 1), (0, 2), (1, 0))
#: category, keywords, words that rule it out, score
HEADERS = (
    ("tool", ("tool #", "tool#", "tool no", "tool no.", "tool number", "tooling #", "tooling#", "tooling", "tool", "mold #", "mold#", "mold no", "die #", "die#"), (), 0),
    ("cycle_time", ("cycle time (sec)", "cycle time (s)", "cycle time", "cycle sec", "cycle (sec)", "c/t (s)", "c/t (sec)", "c/t", "sec/shot", "molding cycle"), (), 25),
    ("description", ("part description", "part desc", "part desc.", "part discription", "description", "discription", "desc", "desc."),
     ("resin", "material", "generic", "raw", "tool", "machine", "press", "supplier", "vendor", "grade"), 15),
    ("material_grade", ("resin grade", "material grade", "resin grade description", "grade"),
     ("supplier", "vendor", "distributor", "generic", "mfr", "manufacturer", "tool"), 15),
    ("material_generic", ("material", "resin", "raw material", "material description", "raw material description"),
     ("supplier", "vendor", "distributor", "generic", "mfr", "manufacturer", "tool"), 15),
    ("ops", ("#ops", "# ops", "ops", "labour", "labor", "operators", "operator", "# operators"), (), 10),
    ("weight", ("weight (g)", "weight(g)", "part weight (g)", "part wt (g)", "part weight", "weight", "wt (g)"), (), 10),
    ("volume", ("ann. volume (eau)", "ann. volume", "annual volume (eau)", "annual volume", "volume (eau)", "volume", "eau", "ann volume"), (), 15),
    ("part_specific", ("customer part #", "customer part#", "customer part number", "customer part", "customer p/n", "part number", "part no", "part no.", "part #", "part#", "p/n"),
     ("review", "evaluation", "evaluate", "assessment", "checklist", "feasibility", "complexity", "criteria", "status", "question", "fit", "awarded", "package", "complete", "priority"), 35),
    ("part_generic", ("part id", "part"),
     ("review", "evaluation", "evaluate", "assessment", "checklist", "feasibility", "complexity", "criteria", "status", "question", "fit", "awarded", "package", "complete", "priority"), 10),
    ("quote", ("quote number", "quote #", "quote#", "quote no", "quote no.", "mpc rfq #", "mpc rfq#", "mpc rfq no", "mpc rfq", "quote item #", "quote item#", "quote item no", "quote item", "rfq #", "rfq#", "rfq no"), (), 25),
    ("item", ("item #", "item#", "item no", "item no.", "item number", "line item", "line #", "line#", "line", "item", "pos #", "pos#", "pos"), (), 15),
    ("drawing", ("drawing number", "drawing no", "drawing #", "drawing", "dwg number", "dwg no", "dwg #", "dwg"), (), 5),
)
