"""Rule sets as data. Every function that uses one takes it as a parameter."""

from __future__ import annotations

from types import SimpleNamespace

# Patterns, word lists and constants that results depend on.

POSITIVE_CUES = [
    r"\b(advises|advised|urges|encourages|reminds|warns|alert|caution)\b",
    r"\b(avoid|register|report|vaccinate|boil|evacuate|verify|apply by|file|filing)\b",
    r"\b(deadline|before|by \d|within \d+\s*(hours|days)|due date)\b",
    r"\b(ministry of|iebc|ndma|nps|helb|kuccps|who|unicef|huduma|eacc|kra|treasury|knec|nema|ntsa|meteo)\b",
    r"\b(public (is )?advised|members of the public|public notice|press release)\b",
    r"\b(voter|voting|polling|ballot|by-?election|voter registration)\b",
    r"\b(the commission (reminds|urges|advises|informs))\b",
    r"\b(clarification|accreditation|service delivery|huduma (centre|center))\b",
    r"\b(anti-?corruption|report corruption|integrity|accountability|good governance)\b",
    r"\b(fight against corruption|safeguarding|public resources|transparency)\b",
    r"\b(taxpayer|tax returns|excise|vat|customs|compliance|communications authority)\b",
    r"\b(government|president|cabinet|national assembly|senate|public service)\b",
    r"\b(outbreak|immunization|vaccine|mpox|cholera|malaria|hiv|tb|maternal|nutrition|hospital|clinic|sha|nhif)\b",
    r"\b(school|learner|student|exam|kcse|kcpe|scholarship|bursary|enrollment|capitation|tvet)\b",
    r"\b(flood|drought|disaster|evacuation|road safety|police|crime|cyber|scam|phishing)\b",
    r"\b(farmer|crop|livestock|fertilizer|harvest|irrigation|pest|agriculture)\b",
    r"\b(weather forecast|advisory|early warning|bulletin|red cross|relief)\b",
]
NEGATIVE_CUES = [
    r"\b(match report|celebrity|premier league|gossip|rumour)\b",
    r"\b(explore partnership|signed an? mou|capacity-?building|breakfast meeting)\b",
    r"\b(country brief|situation report|format situation report)\b",
    r"\b(strengthen collaboration|hosts? .{0,20}for talks)\b",
]
AUTHORITY_PREFIX = r"^(ministry of|iebc|ndma|nps|helb|kuccps|who|unicef|huduma|eacc|kra|public notice|clarification|aaaca|press release|president|ca\b|knec|nema|kenya red cross|fao)"
ORGANISATIONS = (
    r"\b(kenya revenue authority|communications authority|ethics and anti-corruption|independent electoral|ministry of health|ministry of education|"
    r"kenya meteorological|national drought|kenya red cross|world health organization|unicef|knec|nema)\b"
)
IMPERATIVES = r"\b(avoid|must|shall|do not|don't|ensure|prohibited|required|deadline)\b"

ACTION = (
    r"\b(advise|advised|urges?|urged|warns?|warned|reminds?|reminded|alert|caution|avoid|do not|don't|must|shall|prohibited|required|"
    r"register (to|for|by)|verify|report (to|any|immediately)|evacuate|boil water|wash (your )?hands|vaccinat|immuni|deadline|"
    r"members of the public|general public|all kenyans|public is (hereby )?informed|public (is )?advised|"
    r"citizens? are (advised|reminded|requested)|the commission (reminds|urges|advises|informs)|"
    r"are requested to|is requested to|take (immediate )?action|stay (indoors|away|alert)|keep (off|away)|"
    r"polling stations? will be open|present your (original )?national identity)\b"
)
PRESS = (
    r"\b(launched|inaugurated|announced|announces|statement by the (cabinet secretary|cs|principal secretary)|"
    r"official visit|media invited|press (conference|briefing)|signed an? (mou|memorandum)|explore (partnership|cooperation)|"
    r"hosts? .{0,40}(for talks|stakeholders|delegation)|capacity-?building|breakfast meeting|strengthen (collaboration|partnership)|"
    r"was (held|attended|presided)|in a speech|the (cabinet secretary|principal secretary) (said|noted|stated)|"
    r"according to|he said|she said)\b"
)
OTHER = (
    r"\b(it is notified for the general information|pursuant to|in exercise of the powers|gazette notice|kenya gazette|"
    r"tender\s*(no\.?|number)|invitation to tender|appointment of|appoints? .{0,40}as |vacancy|vacancies|job advertisement|"
    r"bill (no\.?|of)|act (no\.?|of)|subsidiary legislation|public procurement|expression of interest|"
    r"board of directors|commissioners? (are|is) hereby)\b"
)
QUOTES = r"\b(he said|she said|according to)\b"

FORCE = (
    r"\b(public notice|press release|advisory|alert|members of the public|general public|citizens? are (advised|reminded)|"
    r"the commission (reminds|urges|advises|informs)|prohibited|must present|deadline|register (to|for|by)|"
    r"vaccinat|immuni|evacuate|curfew|boil water|wash (your )?hands)\b"
)
NAVIGATION = (
    r"(main navigation|home about us|quick links|copyright|all rights reserved|facebook|twitter tweets|staff mail|"
    r"organogram|cookie|subscribe to|current page \d|next page|last page|skip to content)"
)
LISTING = r"(SNo Notice Description|Notice Description Notice Year Notice Link)"
NGO_STUB = (
    r"(pray with us|click on the link to view|become a force for positive|get involved|our structure|our vision and values|"
    r"take action today|follow us on twitter|download publication|annual reports?/)"
)
OFF_TOPIC = r"\b(stadium|indoor games|football|celebrity|gossip|goonism|bhang trafficking|transfer rumour|trending|premier league)\b"
LISTICLE = r"\b(full list|list of (public )?universities|courses in kenya|how to apply for)\b"
GENRE = (
    r"\b(explore (partnership|closer cooperation|cooperation)|signed an? (mou|memorandum)|capacity-?building|"
    r"breakfast meeting|country brief|situation report|format situation|strengthen (collaboration|partnership)|"
    r"hosts? .{0,40}(for talks|stakeholders)|presents? .{0,40}to (senate|committee)|engages? .{0,40}associations?|"
    r"joins multi-agency|reviews? (isms|ict policies)|circular bioeconomy|resilient livelihoods|originally published|posted \d)\b"
)
REPORT = r"\b(country brief|situation report|format situation|key message update)\b"
ABOUT_PAGES = ["/get-involved", "/about-us/", "/role-faith", "/annual-reports", "/faq"]
NGO_HOSTS = ["wvi.org", "amref.org", "vsointernational", "actionagainsthunger"]
GATE_LANGUAGES = ["en", "sw", "", "unknown"]

BOILERPLATE = r"^(home|menu|share|tweet|copyright|all rights reserved|subscribe|related|read also|advertisement|click here)"
STOP_MARKERS = (
    r"\n\s*(related (articles|posts|news)|share this|leave a (reply|comment)|tags?:|categories?:|copyright|all rights reserved|"
    r"subscribe|about the author|also read|you may also like)\b"
)
TOKEN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?|[^\sA-Za-z0-9]"

SWAHILI_CUES = "na ya wa kwa ni katika hii hizo tafadhali serikali afya elimu usalama kilimo raia ombi habari angalia epuka ripoti hospitali chanjo uchaguzi kura".split()
SWAHILI_MARKERS = "wa ya za katika kwa na ni cha vya serikali watu rais sisi yake kazi hili hiyo wizara umma".split()
NOTICE_WORDS = "health vaccine school election vote police farm water government ministry register warning emergency hospital county please must should avoid report doctor child food safe disease".split()

DOMAIN_LABELS = {
    "health": "Health", "agriculture": "Agriculture", "education": "Education", "security": "Security",
    "security & safety": "Security", "governance": "Governance", "general": "Governance", "uncategorized": "Governance",
}

#: (domain, sub-category, keywords) in the order that decides ties.
DOMAINS = [
    ("health", "disease_prevention_and_control", ["malaria", "vaccination", "hiv", "tb", "tuberculosis", "ebola", "cholera", "outbreak", "immunization", "vaccine"]),
    ("health", "maternal_and_child_health", ["maternal", "pregnancy", "infant", "child vaccination", "nutrition", "antenatal"]),
    ("health", "public_health_campaigns", ["hygiene", "sanitation", "handwashing", "diabetes", "ncd", "wash"]),
    ("health", "mental_health_awareness", ["mental health", "stress", "suicide", "counseling", "depression"]),
    ("health", "healthcare_access", ["health insurance", "nhif", "sha", "medical camp", "hospital", "clinic"]),
    ("agriculture", "crop_production", ["crop", "harvest", "pest", "drought-resistant", "maize", "fertilizer"]),
    ("agriculture", "livestock_management", ["livestock", "cattle", "vaccination", "grazing", "poultry"]),
    ("agriculture", "agribusiness_and_market_access", ["market", "cooperative", "fair trade", "export", "price"]),
    ("agriculture", "sustainable_farming", ["organic", "soil conservation", "irrigation", "water management"]),
    ("agriculture", "agricultural_training", ["training", "extension", "farming techniques", "subsidy"]),
    ("education", "access_to_education", ["enrollment", "school", "literacy", "free education", "capitation"]),
    ("education", "vocational_training", ["tvet", "vocational", "skills training", "apprenticeship"]),
    ("education", "civic_education", ["civic", "voter education", "rights", "constitution"]),
    ("education", "educational_resources", ["scholarship", "bursary", "helb", "textbook", "kuccps"]),
    ("education", "school_safety_and_inclusion", ["bullying", "disability", "safe school", "inclusion"]),
    ("security", "public_safety_awareness", ["road safety", "fire", "flood", "drought", "disaster", "ndma", "evacuation"]),
    ("security", "crime_prevention", ["crime", "police", "report", "corruption", "community policing"]),
    ("security", "national_security", ["terrorism", "border", "peace", "security alert"]),
    ("security", "gender_based_violence", ["gbv", "domestic violence", "sexual assault", "gender"]),
    ("security", "cybersecurity", ["mpesa", "scam", "phishing", "cyber", "online safety", "fraud"]),
    ("governance", "anti_corruption_initiatives", ["eacc", "corruption", "transparency", "integrity"]),
    ("governance", "public_participation", ["public participation", "forum", "consultation", "devolution"]),
    ("governance", "elections_and_voter_education", ["iebc", "voter", "election", "register", "ballot", "polling"]),
    ("governance", "public_service_delivery", ["huduma", "ecitizen", "passport", "id", "birth certificate", "kra"]),
    ("governance", "devolution_and_local_governance", ["county", "governor", "ward", "cec", "local government"]),
]
URGENCY = [
    ("emergency", ["emergency", "outbreak", "evacuate", "immediate", "danger", "red alert", "crisis"]),
    ("high", ["warning", "deadline", "register by", "urgent", "alert", "within 24", "within 48"]),
    ("medium", ["campaign", "awareness", "notice", "reminder", "upcoming"]),
    ("low", ["information", "update", "general"]),
]
AUDIENCES = [
    ("parents", ["parent", "guardian", "school", "child"]),
    ("students", ["student", "pupil", "university", "helb", "kuccps"]),
    ("farmers", ["farmer", "agriculture", "crop", "livestock"]),
    ("drivers", ["driver", "road", "traffic", "motorist"]),
    ("businesses", ["business", "sme", "trader", "entrepreneur"]),
    ("health_workers", ["health worker", "nurse", "clinician", "chv"]),
]
#: (kept form, other forms).
GLOSSARY = [
    ("IEBC", []), ("EACC", []), ("NHIF", []), ("SHA", []), ("NDMA", []), ("KRA", []), ("HELB", []), ("KUCCPS", []), ("TVET", []), ("Huduma", []), ("eCitizen", []),
    ("M-PESA", ["Mpesa", "MPESA", "m-pesa"]), ("KSh", ["KES", "Kshs", "Ksh"]), ("GBV", []), ("CHV", []), ("NCD", []), ("WASH", []), ("county", []), ("ward", []),
    ("baraza", []), ("harambee", []), ("ugali", []), ("bodaboda", ["boda boda", "boda-boda"]), ("matatu", []),
]
BILINGUAL_DOMAINS = [
    ("Health", ["health", "vaccine", "outbreak", "hospital", "afya", "chanjo", "magonjwa", "wizara ya afya", "dawa", "ebola", "cholera", "malaria", "epidemic", "sanitation", "daktari", "maradhi", "covid", "virus", "hospitali", "disease", "polio"]),
    ("Agriculture", ["crop", "farming", "livestock", "maize", "drought", "kilimo", "mbolea", "mifugo", "ukame", "pests", "locusts", "pembejeo", "harvest", "irrigation", "mvua", "wakulima", "food security", "el nino"]),
    ("Education", ["school", "kuccps", "students", "exam", "kcse", "kcpe", "elimu", "shule", "masomo", "mtihani", "bursary", "helb", "university", "curriculum", "walimu", "knec", "grade", "education", "cbc"]),
    ("Security", ["police", "safety", "crime", "ntsa", "traffic", "usalama", "polisi", "ajali", "uhalifu", "barabara", "disaster", "flood", "security", "accident"]),
    ("Governance", ["iebc", "voter", "elections", "e-citizen", "eacc", "tax", "kra", "ilani", "mamlaka", "wapiga kura", "serikali", "gazette", "notice", "public", "huduma", "pasipoti", "county", "government"]),
]
#: (id, name, model code, role).
LANGUAGES = [("en", "English", "eng_Latn", "source"), ("sw", "Kiswahili", "swh_Latn", "pivot"), ("kik", "Kikuyu", "kik_Latn", "target")]
EXTERNAL_METHODS = ["external_opus", "synthetic_template"]
EXTERNAL_FILES = ["en_sw_pairs.csv"]
RECOVERABLE = ["too_long_for_psa", "very_long_report", "weak_long_narrative", "genre_news_not_psa"]
RECOVERABLE_PREFIXES = ["weak_long", "weak_forced", "core_failed", "low_psa_score:0.3"]

# End of fixed values.

#: The default rules, and rules of words that ordinary prose has, so that every
#: branch of the cascades is taken on any corpus.
NOTICE_RULES = SimpleNamespace(
    positive=POSITIVE_CUES, negative=NEGATIVE_CUES, prefix=AUTHORITY_PREFIX, organisations=ORGANISATIONS, imperatives=IMPERATIVES,
    action=ACTION, press=PRESS, other=OTHER, quotes=QUOTES, force=FORCE, navigation=NAVIGATION, listing=LISTING, stub=NGO_STUB,
    off_topic=OFF_TOPIC, listicle=LISTICLE, genre=GENRE, report=REPORT,
)
PROSE_RULES = SimpleNamespace(
    positive=[r" (the|und) ", r" (of|der) ", r" (and|les) ", r" (that|que) "], negative=[r" (haning|thely) ", r" (with|sur) "], prefix=r"^(the|of|and|er)",
    organisations=r" (by the|of the|de la) ", imperatives=r" (was|were|not|nicht) ", action=r" (for|in a|heit) ", press=r" (with|from the) ", other=r" (la|die) ",
    quotes=r" (in the|as a) ", force=r" (here|there|des) ", navigation=r"(licensed under|http)", listing=r"(\|\s\w+\s\|)", stub=r"(!! )", off_topic=r" (have) ",
    listicle=r" (thing|mit) ", genre=r" (of th\w{0,9}) ", report=r" (not that|von der) ",
)
