"""Rule tables. Operators take rules as arguments; these are the domain's own and sets that fit the given tables."""

# Fixed values of the domain: topics in order of precedence.
TOPICS = [
    ("Power & capacity", "power|energy|electric|megawatt|gigawatt|capacity|campus|data cent(?:er|re)"),
    ("Customers & demand", "customer|contract|backlog|demand|revenue|reservation|pipeline"),
    ("Financing & liquidity", "financ|liquidity|debt|capital|cash|credit|convertible|lease"),
    ("Compute & accelerators", "gpu|accelerator|nvidia|amd|compute|cluster|server|rack"),
    ("Networking", "network|ethernet|infiniband|optical|switch|fabric"),
    ("Operations & execution", "construction|delivery|deploy|operation|utilization|supply|delay"),
    ("Competition & strategy", "competition|competitor|strategy|market|hyperscal|differentiat"),
    ("Risk factors", "risk|uncertain|adverse|depend|concentrat|could harm|may not"),
]
DEFAULT_TOPIC = "Company developments"

# Fixed values of the domain: labels that crowd in broken tables, and words of tone.
TABLE_LABELS = "actual|guidance|sites?|revenue|arr|mw|gpu|customers?|capacity"
STRONG = "achieved|accelerat|confiden|exceed|expanded|growth|increased|record|secured|strong"
WEAK = "adverse|constraint|declin|delay|depend|decreased|loss|pressure|risk|weaken"
UNSURE = "could|may|might|uncertain|subject to|no assurance|cannot guarantee"

# Rules that fit the given prose.
PROSE_TOPICS = [("relation", "tion|sion"), ("action", "ing"), ("article", "the|der|les|los"), ("link", "and|und|et")]
PROSE_LABELS = "the|of|and|to|in|is"
PROSE_MATERIAL = "the|of|and|to|in|is|by|with|on|for|are|was"
PROSE_SPECIFIC = "that|this|from|were|have"
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "by", "with", "on", "for", "are", "was"]
PROSE_CLAIMS = [("growth", "tion|sion", False), ("demand", "ing|ed", False), ("funding", "the|der", True), ("customer", "and|und", True), ("execution", "les|los|ble", True)]
PROSE_SIGNALS = [("action", 25, r"ing\b"), ("relation", 25, r"tion\b"), ("article", 20, r"\b(?:the|der|les|los)\b"), ("link", 20, r"\b(?:et|und|y)\b")]
PROSE_POSITIVE, PROSE_NEGATIVE = "is|was|are", "of|by|un"

# Fixed values of the domain: text that is no research evidence.
BOILERPLATE = [
    r"pursuant to the requirements of the securities exchange act",
    r"has duly caused this report to be signed",
    r"furnished as exhibit\s+\d",
    r"incorporated (?:herein )?by reference",
    r"^\s*\d{1,3}\.\d\s+(?:press release|financial statements|exhibit)",
    r"^\s*\d{1,3}(?:\.\d+)?\**\s+(?:agreement|credit agreement|certificates?|form of|incremental|press release|financial statements?|exhibit)",
    r"^\s*\d{1,3}(?:\.\d+)?\W+indenture, dated as of",
    r"^form of certificates? representing",
    r"\bcopy of .* (?:is|are|will be) (?:filed as|attached as) an? exhibit\b",
    r"\bcopy of .* (?:is|are|will be) attached as exhibit\b",
    r"shall not constitute an offer to sell or the solicitation of (?:(?:an|any) )?offer to buy",
    r"the offer and sale of .* (?:is|are) and will be made in reliance upon .* exemption from registration",
    r"contains customary representations, warranties, covenants, indemnities and termination rights",
    r"^(?:indenture|agreement), dated as of .* between .* and .* as (?:trustee|agent)",
    r"contains [\"“”]?forward-looking statements[\"“”]? within the meaning of",
    r"^the following table summarizes our results of operation",
    r"the information (?:contained|included) in this (?:report|item) .* shall not be deemed",
]

# Fixed values of the domain: words that turn a statement round, and pairs of opposite directions.
NEGATIONS = "cannot|can't|did not|didn't|does not|doesn't|failed to|has not|hasn't|have not|haven't|is not|isn't|never|no|not|was not|wasn't|were not|weren't|without"
DIRECTIONS = [
    ("above|exceed(?:ed|s|ing)?|higher|increase(?:d|s|ing)?|grew|growth|rose", "below|decline(?:d|s|ing)?|decrease(?:d|s|ing)?|fell|lower|shrank"),
    ("before|earlier", "after|later"),
    ("gain(?:ed|s|ing)?|profit(?:able|ability|s)?", "loss(?:es)?|lost|unprofitable"),
]

# Fixed values of the domain: headings of filing sections, in order of precedence: category, title, pattern.
SECTIONS = [
    ("Risk", "Risk Factors", r"^(?:item\s+1a[.\s:-]*)?risk factors?\.?$"),
    ("Liquidity", "Liquidity and Capital Resources", r"^(?:item\s+7[.\s:-]*)?liquidity and capital resources\.?$"),
    ("Operations", "Management's Discussion and Analysis", r"^(?:item\s+7[.\s:-]*)?management['’]s discussion and analysis"),
    ("Operations", "Results of Operations", r"^(?:item\s+2\.02[.\s:-]*)?results of operations"),
    ("Business", "Business Overview", r"^(?:item\s+1[.\s:-]*)?(?:our )?business(?: overview)?\.?$"),
    ("Capacity", "Capital Expenditures", r"^(?:capital expenditures|capital spending|data center capacity)\.?$"),
    ("Demand", "Customers and Demand", r"^(?:customers?|customer concentration|customers and demand)\.?$"),
    ("Agreement", "Material Agreement", r"^item\s+1\.01[.\s:-]*(?:entry into a )?material definitive agreement"),
    ("Event", "Other Material Events", r"^item\s+8\.01[.\s:-]*other events"),
    ("Financials", "Financial Statements", r"^item\s+9\.01[.\s:-]*financial statements"),
]

# Fixed values of the domain: item codes of named sections, formulas of cover pages.
ITEM_CODES = [("Results of Operations", "2.02"), ("Material Agreement", "1.01"), ("Other Material Events", "8.01"), ("Financial Statements", "9.01")]
COVER_PAGE = ["check the appropriate box below", "pre-commencement communications", "securities registered pursuant", "emerging growth company", "indicate by check mark", r"exchange act \(17 cfr"]

# Fixed values of the domain: topics of releases in order of precedence, and what is boilerplate in them.
RELEASE_TOPICS = [
    ("Capacity", r"\b(?:capacity|data cent(?:er|re)|gpu|accelerator|cluster|rack|megawatt|mw|gigawatt|gw)\b"),
    ("Revenue", r"\b(?:revenue|arr|annualized run-rate|gross profit|gross margin|adjusted ebitda|operating loss)\b"),
    ("Capital spending", r"\b(?:capex|capital expenditure|capital spending|property and equipment|infrastructure investment)\b"),
    ("Power", r"\b(?:power|electricity|grid|energy|energization|substation|renewable)\b"),
    ("Customers", r"\b(?:customer|contract|agreement|backlog|demand|hyperscaler|meta|microsoft)\b"),
    ("Financing", r"\b(?:financing|liquidity|cash balance|debt|convertible|credit facility|equity|atm program)\b"),
    ("Guidance", r"\b(?:guidance|outlook|we expect|we target|expected to|forecast for|by the end of|full-year target)\b"),
    ("Risk", r"\b(?:risk|uncertain|constraint|delay|shortage|concentration|competition|may adversely)\b"),
]
RELEASE_BOILERPLATE = ["forward-looking statements?", "actual results .* differ materially", "cautioned not to .* rely", "copyright .* all rights reserved"]

# Fixed values of the domain: alert categories in order of precedence, and words of direction.
ALERTS = [
    ("Capacity", r"capacity|data center|gpu|power|megawatt|mw\b|capital expenditure|capex"),
    ("Funding", "liquidity|financing|debt|capital market|borrow|convertible note"),
    ("Customer", "customer|concentration|counterparty"),
    ("Demand", "revenue|backlog|demand|contract|workload|utilization"),
    ("Execution", "construction|delay|deliver|execution|schedule|operating risk"),
]
STRENGTHENS = "additional|award|backlog|contracted|expanded|expansion|growth|increase|increased|new capacity|sufficient|strong"
WEAKENS = "adverse|concentration|constraint|debt|decrease|decreased|delay|dependent|impair|loss|risk|uncertain"
RISK_CATEGORIES = ["Funding", "Customer", "Execution"]

# Fixed values of the domain: kinds of live events in order of precedence, and what makes one material.
EVENT_KINDS = [
    ("Capacity", r"\bcapacity|data cent(?:er|re)|megawatt|gigawatt|\bmw\b|\bgw\b|campus|facility"),
    ("Customers", r"\bcustomer|contract|backlog|reservation|workload|demand"),
    ("Financing", r"\bfinancing|liquidity|debt|convertible|credit facility|capital raise|offering"),
    ("Compute", r"\bgpu|accelerator|compute|cluster|nvidia|amd\b"),
    ("Power", r"\bpower|grid|energiz|electricity|utility|substation"),
    ("Execution", r"\bdelay|construction|delivery|schedule|outage|constraint|permit"),
    ("Results", r"\bearnings|quarter|revenue|financial results|guidance|outlook"),
    ("Partnership", r"\bpartner|agreement|collaboration|joint venture"),
]
EVENT_MATERIAL = ["megawatt|gigawatt|mw|gw", "billion|million|financing|debt|convertible|credit facility", "contract|customer|backlog|capacity|data cent(?:er|re)|gpu|accelerator", "delay|cancel|default|outage|constraint|investigation"]

# Fixed values of the domain: words whose coming or going makes a change of text significant.
MATERIAL_TERMS = ["backlog", "capacity", "capital", "capex", "customer", "customers", "debt", "demand", "financing", "liquidity", "power", "revenue", "risk", "risks", "utilization"]

# Fixed values of the domain: sections that periodic filings repeat, and words that do not count in comparisons.
RECURRING = ["Risk", "Liquidity", "Operations", "Business", "Capacity", "Demand"]
RECURRING_TITLE = "management.s discussion|md&a|risk factors|liquidity|results of operations|business|capacity|demand"
FILING_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "our", "that", "the", "their", "this", "to", "was", "we", "were", "with"]

# Fixed values of the domain: items of event filings (code, type, base score, category, whether administrative), signals in order
# (category, weight, pattern), and what is boilerplate in events.
ITEM_POLICIES = [
    ("1.01", "Material agreement", 35, None, False),
    ("1.02", "Agreement termination", 35, None, False),
    ("2.02", "Operating results", 45, "Demand", False),
    ("2.03", "Financial obligation", 55, "Funding", False),
    ("2.04", "Acceleration trigger", 60, "Funding", False),
    ("2.05", "Exit or disposal plan", 35, "Execution", False),
    ("2.06", "Material impairment", 45, "Execution", False),
    ("4.01", "Auditor change", 5, None, True),
    ("5.02", "Leadership change", 10, None, False),
    ("5.07", "Shareholder vote", 0, None, True),
    ("7.01", "Regulation FD update", 25, None, False),
    ("8.01", "Other material event", 20, None, False),
    ("9.01", "Exhibits and financial statements", 0, None, True),
]
EVENT_SIGNALS = [
    ("Capacity", 25, r"\b(?:data cent(?:er|re)|gpu|accelerator|megawatt|mw\b|power capacity|powered capacity|cluster|compute capacity|capital expenditure|capex)\b"),
    ("Funding", 25, r"\b(?:credit facilit|financing|liquidity|debt|borrow|loan|lender|convertible note|revolving credit|interest rate|principal amount)\b"),
    ("Demand", 20, r"\b(?:revenue|backlog|contracted|workload|utilization|demand|reservation|purchase commitment|service agreement)\b"),
    ("Customer", 20, r"\b(?:customer|counterparty|concentration|tenant|offtake)\b"),
    ("Execution", 20, r"\b(?:construction|delivery|schedule|delay|permit|interconnect|energization|deployment|impairment|termination)\b"),
]
EVENT_BOILERPLATE = r"\b(?:incorporated by reference into this item|shall not constitute an offer|schedules? to this agreement have been omitted|furnish supplementally|pursuant to item 601|signature(?:s)?\s*$)\b"
EXHIBIT_LINE = r"^\s*\d{1,3}(?:\.\d+)?\*{0,2}\s+.{0,80}(?:agreement|statement|certificate|press release)"

# Fixed values of the domain: contexts that make a metric doubtful.
OFFERING = "prospectus|offer and sale|securities|at-the-market|equity offering|convertible notes?|capitalization table|net proceeds"
COMPONENT = r"(?:increase|decrease|reduced|improved|declined)(?:\s+in)?\s+revenue[^.]{0,45}\bby\b|attributable to|contributed \$"
FACILITY = "campus|site|building|data cent(?:er|re)|forge|facility"
MARKET = "market size|total addressable market|industry estimate|peer spending"
FINANCIAL_KEYS = ["revenue", "capex", "liquidity", "operating_cash_flow", "debt", "backlog", "contract_value"]

# Fixed values of the domain: patterns of amounts (kind, pattern, characters of the text around), labels of money (metric, pattern,
# confidence) in order of precedence, what excludes a match, and words that tell kinds of power.
AMOUNTS = [
    ("money", r"(?:US\s*)?\$\s*([\d,.]+)\s*(billion|million|bn|mm|m|b)?", 90),
    ("power", r"([\d,.]+)\s*(GW|MW|gigawatts?|megawatts?)(?:\b|\s)", 60),
    ("gpu", r"([\d,]{3,})\s+(?:NVIDIA\s+|AMD\s+)?(?:GPUs?|accelerators?)", 0),
    ("gpu_after", r"(?:GPUs?|accelerators?)\s+(?:of\s+|totaling\s+|approximately\s+)?([\d,]{3,})", 0),
]
MONEY_METRICS = [
    ("annual_recurring_revenue", r"annual recurring revenue|\bARR\b", 92),
    ("contract_value", r"\bcontract(?:ed)?(?:\s+\w+){0,2}\s+(?:value|revenue)|customer commitment|capacity reservation", 84),
    ("backlog", r"\bbacklog|remaining performance obligation", 92),
    ("revenue", r"\brevenue|sales\b", 91),
    ("capex", r"\bcapex|capital expenditure|capital spending", 90),
    ("liquidity", r"\bliquidity|cash and cash equivalents|cash balance", 89),
    ("operating_cash_flow", "operating cash flow|cash flow from operations", 88),
    ("debt", r"\bdebt|borrowings|convertible notes?|credit facility", 87),
]
MARKET_ESTIMATE = "hyperscalers? capex estimates?|amazon|alphabet|google|meta platforms|microsoft|market size|total addressable market|megaprojects|industry estimate"
PART_OF_REVENUE = r"prospectus|offer and sale|securities|at-the-market|equity offering|convertible notes?|net proceeds|(?:increase|decrease|reduced|declined)(?:\s+in)?\s+revenue[^.]{0,70}(?:\bby\b|\bdue to\b)|attributable to"
FINANCING_TABLE = "capitalization table|macquarie expect to invest|issuer|equity commitment|net proceeds"
POWER_NEARBY = "power|capacity|campus|data cent(?:er|re)|building|energized|grid"
POWER_ACTIVE = r"energized|\blive\b|active power|in service|operates?"
POWER_PLANNED = "contracted|secured|guidance|pipeline|planned|under construction|development capacity|available power|expected|will be operational"

# Fixed values of the domain: what decides whether a change is good or bad news.
OPPORTUNITY = "revenue|demand|customer|contract|capacity|power|gpu|compute|utilization|pipeline|growth|deployment"
THREAT = "debt|borrow|funding|financ|cost|concentrat|delay|risk|constraint|liabilit"
LIQUIDITY = "cash|liquidity"

# Fixed values of the domain: what a claim of each section speaks of, words without content in claims, openings of slides and notes
# that are no sentences, fragments that stand for a sentence ({} is the company), and openings by which a sentence is retold.
CLAIM_SECTIONS = {
    "exposure": r"\b(?:ai|capacity|cloud|compute|data cent(?:er|re)|gpu|hpc|infrastructure|megawatt|mw\b|gigawatt|gw\b|power)\b",
    "advantages": r"\b(?:availability|capital investment|contracted|demand|expand|growth|increase|infrastructure business|launch|liquidity|scale|secured|signed)\b",
    "risks": r"\b(?:capital|concentrat|constraint|cost|credit|debt|delay|dependent|financ|liquidity|loss|risk|uncertain)\b",
    "catalysts": r"\b(?:availability|capacity|contract|deliver|deploy|energiz|expand|guidance|launch|milestone|pipeline)\b",
}
CLAIM_STOP_WORDS = ["about", "after", "also", "been", "being", "between", "could", "disclosed", "from", "have", "into", "more", "most", "over", "reported", "that", "their", "there", "these", "they", "this", "through", "under", "which", "with", "would", "company", "group"]
SLIDE = r"^(?:company timeline|ai factories hyperscalers capex estimates)\b"
ESTIMATE_NOTE = r"based on company guidance \+ analyst consensus|approximate calendar-year basis"
CLAIM_FRAGMENTS = [
    r"\b{}\s+has\s+secured\s+[$€£]\s?\d[\d,.]*\s*(?:billion|million|bn|mn|b|m)?[^.;]{{0,80}}?(?:contracted lease value|contract value)",
    r"\bsigned\b[^.;]{20,220}?\b\d[\d,.]*\s*(?:mw|gw)\b(?:\s+of\s+(?:critical\s+)?it\s+load)?",
    r"\brevenue growth\b[^.;]{20,180}?(?:customer acquisition|program enhancements|year over year|yoy)",
    r"\b\d[\d,.]*\s+billion in total contracted baseline revenue under \d[\d,.]*-year take-or-pay lease agreements",
]
REPORTED_SPEECH = r"""^".*"\s*,?\s*(?:said|stated|according to)\b"""
OWN_VERBS = "completed|contracted|entered|established|launched|reported|secured|signed"
OWN_FIGURES = "revenue|capacity|cash|liquidity|capital expenditures?|backlog"
