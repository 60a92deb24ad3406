"""Word lists and patterns the rules match on.

Everything in this module is a fixed value: the terms decide results and are
kept as plain regular expressions, one term per entry. ``patterns`` puts them
together into what Spark matches with.
"""

from __future__ import annotations

# --- Fixed values: title vocabularies --------------------------------------

AI_TERMS = [
    r"machine[\s\-]?learning", r"\bml\b", r"\bmle\b", r"\bmlops\b", r"\bai\b", r"\ba\.i\.",
    r"artificial[\s\-]?intelligence", r"deep[\s\-]?learning", r"\bnlp\b",
    r"natural[\s\-]?language", r"computer[\s\-]?vision", r"\bcv\b(?![\s\-]?(?:file|upload))",
    r"\bllm[s]?\b", r"large[\s\-]?language[\s\-]?model", r"foundation[\s\-]?model",
    r"gen[\s\-]?ai", r"generative", r"neural", r"transformer",
    r"reinforcement[\s\-]?learning", r"\brlhf\b", r"data[\s\-]?scien", r"data[\s\-]?engineer",
    r"applied[\s\-]?scien", r"research[\s\-]?scien", r"research[\s\-]?engineer",
    r"\bperception\b", r"\bautonomy\b", r"autonomous", r"self[\s\-]?driving", r"\brobotic",
    r"\bspeech\b", r"\basr\b", r"recommend(?:er|ation)", r"\brecsys\b",
    r"quantitative[\s\-]?research", r"\bquantum[\s\-]?(?:machine|comput|software|algorithm)",
    r"\bcomputational\b", r"knowledge[\s\-]?graph", r"\bagentic\b",
    r"\bagent[s]?[\s\-]?(?:engineer|team|platform)",
]

STUDENT_TERMS = [
    r"\bintern\b", r"\binterns\b", r"\binternship", r"\bco[\s\-]?op\b", r"\bcoop\b",
    r"cooperative[\s\-]?education", r"\bstudent\b", r"\bplacement\b", r"work[\s\-]?term",
    r"\bpey\b", r"professional[\s\-]?experience[\s\-]?year", r"\bon[\s\-]?campus\b",
    r"\bundergrad", r"\bapprentice", r"\btrainee\b", r"rotational",
    r"\bw2[5-9]\b", r"\bs2[5-9]\b", r"\bf2[5-9]\b",
]

NEWGRAD_TERMS = [
    r"new[\s\-]?grad", r"new[\s\-]?graduate", r"recent[\s\-]?graduate",
    r"university[\s\-]?graduate", r"campus[\s\-]?hire", r"early[\s\-]?career",
    r"early[\s\-]?talent", r"emerging[\s\-]?talent", r"entry[\s\-]?level",
    r"\bgraduate[\s\-]?program",
]

OFF_FIELD_TERMS = [
    r"\banalog\b", r"mixed[\s\-]?signal", r"\bams\b", r"\bpcba?\b", r"\basic\b", r"\blayout\b",
    r"\bfirmware\b", r"signal[\s\-]?integrity", r"\bvalidation[\s\-]?engineer",
    r"hardware[\s\-]?(?:design|engineer)", r"\bic[\s\-]?design", r"\belectrical\b",
    r"\bmechanical\b", r"\bcivil\b", r"capital[\s\-]?markets", r"\baccounting\b", r"\baudit",
    r"\bmarketing\b", r"\bsales\b", r"human[\s\-]?resources", r"\bhr\b",
    r"talent[\s\-]?acquisition", r"financial[\s\-]?advisor", r"banking[\s\-]?advisor",
    r"client[\s\-]?advisor", r"relationship[\s\-]?manager", r"public[\s\-]?relations",
    r"\bhse\b", r"\btreasury\b", r"\bfp&a\b", r"\bunderwriting\b",
]

TECH_TERMS = [
    r"\bsoftware\b", r"\bdevelop(?:er|ment)\b", r"\bengineer(?:ing|s)?\b",
    r"\bprogramm(?:er|ing)\b", r"\bcod(?:er|ing)\b", r"\bdata\b", r"\banalytics?\b",
    r"\bquant", r"\bresearch", r"\br\s*&(?:amp;)?\s*d\b", r"\bapplications?\b", r"\bcloud\b",
    r"\b(?:app|dev|devsec|sec|cloud|data|net|git|ml|ai)ops\b", r"\bsre\b",
    r"\binfrastructure\b", r"\bnetwork", r"\bsystems?\b", r"\bplatform\b", r"\bsecurity\b",
    r"\bcyber", r"\bqa\b", r"\btest", r"\bautomation\b", r"\bembedded\b", r"\brobotic",
    r"\bcomputer", r"\btech\b", r"\btechnolog", r"\btechnical\b", r"\bdigital\b", r"\bweb\b",
    r"\bmobile\b", r"\bdatabase", r"\bbi\b", r"\bproduct\b", r"\bux\b", r"\bui\b", r"\bgame",
    r"\belectronics\b", r"\btelecom", r"\bgis\b", r"geospatial", r"\bsimulation",
    r"\binformation\b",
]
# Upper case only: the pronoun "it" is not a field of work.
TECH_UPPER = r"\bIT\b"

RETAIL_TERMS = [
    r"part[\s\-]?time", r"\bfranchise\b", r"greenlight[\s\-]?requisition", r"\bstore\b",
    r"\bcashier", r"\bcrew\b", r"pharmacy[\s\-]?student", r"\bcarvery\b", r"\bpizza\b",
    r"\bbakery\b", r"\bdeli\b", r"\bseafood\b", r"\bmeat[\s\-]?(?:cutter|clerk)",
]

REJECT_TERMS = [
    r"\bunpaid\b", r"\bvolunteer", r"\bhigh[\s\-]?school\b", r"\bsecondary[\s\-]?school\b",
    r"\bphd[\s\-]?only\b", r"ph\.?d\.?[\s\-]?(?:students?[\s\-]?)?only",
    r"(?:must|required)[\s\-]?(?:to[\s\-]?)?(?:be[\s\-]?)?(?:a[\s\-]?)?ph\.?d",
    r"ph\.?d\.?[\s\-]?(?:candidates?|students?)[\s\-]?(?:are[\s\-]?)?required",
    r"\bdoctoral[\s\-]?candidates?[\s\-]?only\b",
]

# --- Fixed values: places ---------------------------------------------------

# Province code as its own upper-case token, or the word.
IN_ONTARIO = r",?\s*(?:(?-i:ON)(?![\w-])|ontario\b)"
IN_ONTARIO_OR_ONT = r",?\s*(?:(?-i:ONT?)(?![\w-])|ontario\b)"

# A town name inside a street address is not the town.
NOT_A_STREET = r"(?!\s+(?:rd|road|st|street|ave|avenue|dr|drive|blvd|way|lane|ln)\b)"
# Another state or country after the comma means another town of that name.
OTHER_REGIONS = (
    r"(?:[A-Za-z]{2}(?![\w-])|iowa|ohio|illinois|maine|massachusetts|michigan|minnesota|"
    r"missouri|kansas|indiana|wisconsin|georgia|colorado|connecticut|vermont|virginia|"
    r"new\s+jersey|new\s+york|england|scotland|wales|australia|belgium)"
)
NOT_ELSEWHERE = r"(?!\s*,\s*(?!(?:ON|CA)(?![\w-]))" + OTHER_REGIONS + ")"
# For towns California has too, ", CA" is California and not Canada.
NOT_ELSEWHERE_NOR_CA = r"(?!\s*,\s*(?!ON(?![\w-]))" + OTHER_REGIONS + ")"

SHARED_TOWNS = [
    r"\bwaterloo\b", r"\bhamilton\b", r"\bottawa\b", r"\bmarkham\b", r"\boakville\b",
    r"\bwoodbridge\b", r"\brichmond[\s\-]?hill\b", r"\bscarborough\b", r"\bwhitby\b",
    r"\bpickering\b", r"\bnewmarket\b", r"\bpeterborough\b", r"\bsudbury\b", r"\bniagara\b",
]
SHARED_GTA_TOWNS = [
    r"\baurora\b", r"\bthornhill\b", r"\bstouffville\b", r"\bcaledon\b", r"\bbolton\b",
    r"\bunionville\b", r"\bgeorgetown\b", r"\bhalton[\s\-]?hills\b", r"\borangeville\b",
    r"\bbowmanville\b", r"\bclarington\b", r"\bburlington\b", r"\bmilton\b",
]
CALIFORNIA_TOWNS = [r"\bconcord\b", r"\bking[\s\-]?city\b"]
COMMUTE_SHARED_TOWNS = [
    r"\bwaterloo\b", r"\bhamilton\b", r"\bmarkham\b", r"\boakville\b", r"\bwoodbridge\b",
    r"\brichmond[\s\-]?hill\b", r"\bscarborough\b", r"\bwhitby\b", r"\bpickering\b",
    r"\bnewmarket\b", r"\bcambridge\b",
]
FAR_SHARED_TOWNS = [r"\bottawa\b", r"\bpeterborough\b", r"\bsudbury\b", r"\bniagara\b"]

ONTARIO_PLAIN = [
    r"\bontario\b(?!\s*,\s*(?:california|oregon)\b)", r"\btoronto\b", r"\bgta\b",
    r"greater[\s\-]?toronto", r"\bkanata\b", r"\bnepean\b", r"\bkitchener\b", r"\bguelph\b",
    r"\bmississauga\b", r"\bbrampton\b", r"\bvaughan\b", r"\bnorth[\s\-]?york\b",
    r"\betobicoke\b", r"\boshawa\b", r"\bajax\b", r"\bbarrie\b", r"\bwelland\b",
    r"\bst\.?\s*catharines\b", r"\bbrantford\b", r"\bsarnia\b", r"\bthunder[\s\-]?bay\b",
    r"\bcambridge" + IN_ONTARIO, r"\blondon" + IN_ONTARIO, r"\bkingston" + IN_ONTARIO,
    r"\bwindsor" + IN_ONTARIO, r"\bygk\b", r",\s*(?-i:ON)(?![\w-])", r",\s*ONT(?![\w-])",
    r"\b(?-i:ON)\s*,\s*Canada\b",
]
COMMUTE_PLAIN = [
    r"\btoronto\b", r"\bgta\b", r"greater[\s\-]?toronto", r"\bmississauga\b", r"\bbrampton\b",
    r"\bvaughan\b", r"\bnorth[\s\-]?york\b", r"\betobicoke\b", r"\boshawa\b", r"\bajax\b",
    r"\bkitchener\b", r"\bguelph\b", r"\bygk\b",
]
FAR_PLAIN = [
    r"\bkanata\b", r"\bnepean\b", r"\bbarrie\b", r"\bbrantford\b", r"\bwelland\b",
    r"\bst\.?\s*catharines\b", r"\bsarnia\b", r"\bthunder[\s\-]?bay\b", r"\bbelleville\b",
    r"\bnorth[\s\-]?bay\b", r"\bsault\s+ste\.?\s*marie\b", r"\blondon" + IN_ONTARIO_OR_ONT,
    r"\bkingston" + IN_ONTARIO_OR_ONT, r"\bwindsor" + IN_ONTARIO_OR_ONT,
]


OTHER_CANADA_TERMS = [
    r"\bvancouver\b", r"\bburnaby\b", r"\bkelowna\b", r"\bvictoria,?\s*(?:bc|british)\b",
    r"british[\s\-]?columbia", r"\bmontr[eé]al\b", r"\bqu[eé]bec\b", r"\blaval\b",
    r"\bgatineau\b", r"\bsherbrooke\b", r"\blongueuil\b", r"saint[\s\-]?hubert",
    r"\bcalgary\b", r"\bedmonton\b", r"\balberta\b", r"\bacheson\b", r"\bwinnipeg\b",
    r"\bmanitoba\b", r"\bhalifax\b", r"nova[\s\-]?scotia", r"\bmoncton\b", r"\bfredericton\b",
    r"\bsaskatoon\b", r"\bregina\b", r"saskatchewan", r"new[\s\-]?brunswick", r"newfoundland",
    r"prince[\s\-]?edward[\s\-]?island", r"\byukon\b", r"\bnunavut\b",
    r"northwest[\s\-]?territories", r",\s*(?-i:QC|BC|AB|MB|SK|NS|NB|NL|PE|YT|NT|NU)(?![\w-])",
]
CANADA_TERMS = [r"\bcanada\b", r"\bcanadian\b"]
REMOTE_TERMS = [
    r"\bremote\b", r"\banywhere\b", r"work[\s\-]?from[\s\-]?home\b", r"\bdistributed\b",
    r"\bvirtual\b", r"fully[\s\-]?remote", r"remote[\s\-]?(?:first|friendly)",
]

FOREIGN_TERMS = [
    r"\b(?:u\.?k\.?|scotland|wales|northern\s+ireland)\b",
    r"\b(?:alabama|alaska|arizona|arkansas|california|colorado|connecticut|"
    r"delaware|florida|georgia|hawaii|idaho|illinois|indiana|iowa|kansas|"
    r"kentucky|louisiana|maine|maryland|massachusetts|michigan|minnesota|"
    r"mississippi|missouri|montana|nebraska|nevada|new\s+hampshire|"
    r"new\s+jersey|new\s+mexico|new\s+york|north\s+carolina|north\s+dakota|"
    r"ohio|oklahoma|oregon|pennsylvania|rhode\s+island|south\s+carolina|"
    r"south\s+dakota|tennessee|texas|utah|vermont|virginia|washington|"
    r"west\s+virginia|wisconsin|wyoming)\b",
    r"\b(?:san\s+francisco|san\s+jose|san\s+diego|palo\s+alto|mountain\s+view|"
    r"sunnyvale|cupertino|bellevue|redmond|los\s+angeles|seattle|austin|"
    r"boston|chicago|denver|atlanta|dallas|houston|phoenix|miami|"
    r"philadelphia|pittsburgh|detroit|minneapolis|cambridge,\s*ma)\b",
    r"\b(?:united\s+states|usa|u\.s\.a?\.|india|united\s+kingdom|england|ireland|"
    r"germany|france|spain|poland|romania|netherlands|sweden|norway|denmark|"
    r"switzerland|israel|singapore|japan|china|korea|australia|new\s+zealand|"
    r"brazil|mexico|argentina|philippines|vietnam|taiwan|hong\s+kong|uae|"
    r"dubai|egypt|nigeria|kenya|south\s+africa|portugal|italy|austria|belgium|"
    r"czech|hungary|greece|turkey|finland|estonia|lithuania|ukraine|"
    r"costa\s+rica|colombia|chile|peru|malaysia|indonesia|thailand|pakistan|"
    r"bangladesh|sri\s+lanka)\b",
    r",\s*(?-i:AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|MA|MD|ME|"
    r"MI|MN|MO|MS|MT|NC|ND|NE|NH|NJ|NM|NV|NY|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|"
    r"VA|VT|WA|WI|WV|WY|DC)\b",
    r"\bUS-[A-Z]{2}-",
]
FOREIGN_UPPER = r"\b(?:SF|LA|NYC|DC)\b"

# --- Fixed values: work terms -------------------------------------------------

SEASON_MONTH = {"winter": 1, "spring": 4, "summer": 5, "fall": 9, "autumn": 9,
                "w": 1, "s": 5, "f": 9}
SEASON_NAME = {1: "Winter", 4: "Spring", 5: "Summer", 9: "Fall"}
CYCLE_SEASON_FIRST = r"\b(winter|spring|summer|fall|autumn)\b[\s\-,]*'?(\d{4}|\d{2})\b"
CYCLE_YEAR_FIRST = r"\b(20\d{2})[\s\-–]*(winter|spring|summer|fall|autumn)\b"
CYCLE_SHORT = r"\b([wsf])'?(\d{2}|\d{4})\b"
CYCLE_BARE = r"(?:,|\(|\s[-–])\s*(winter|spring|summer|fall|autumn)\s*\)?\s*(?=\||$)"

# --- Fixed values: description terms, as (label, pattern) ----------------------

DESCRIPTION_TERMS = [
    ("machine learning", r"machine[\s\-]?learning"),
    ("deep learning", r"deep[\s\-]?learning"),
    ("LLMs", r"\bllms?\b|large[\s\-]?language[\s\-]?models?"),
    ("PyTorch", r"\bpytorch\b"),
    ("TensorFlow", r"\btensorflow\b"),
    ("JAX", r"\bjax\b"),
    ("scikit-learn", r"scikit[\s\-]?learn|\bsklearn\b"),
    ("model training",
     r"\btrain(?:ing|ed)?\s+(?:ml\s+|ai\s+|the\s+)?models?\b|model\s+training"),
    ("fine-tuning", r"fine[\s\-]?tun(?:e|ing)"),
    ("NLP", r"\bnlp\b|natural[\s\-]?language[\s\-]?processing"),
    ("computer vision", r"computer[\s\-]?vision"),
    ("MLOps", r"\bmlops\b"),
    ("RAG", r"\brag\b|retrieval[\s\-]?augmented"),
    ("embeddings", r"\bembeddings?\b|vector[\s\-]?(?:database|search|store)"),
    ("reinforcement learning", r"reinforcement[\s\-]?learning"),
    ("data science", r"data[\s\-]?scien(?:ce|tist)"),
    ("feature engineering", r"feature[\s\-]?engineering"),
    ("neural networks", r"neural[\s\-]?net(?:work)?s?"),
    ("transformers", r"\btransformers?\b(?!\s+(?:station|substation))"),
    ("CUDA", r"\bcuda\b"),
    ("generative AI", r"generative[\s\-]?ai|\bgenai\b|gen[\s\-]ai\b"),
    ("ML engineering", r"\bml\s+(?:engineer|pipeline|model|system|infrastructure|platform)"),
    ("AI agents", r"\b(?:ai|llm)[\s\-]?agents?\b|agentic"),
    ("prompt engineering",
     r"prompt[\s\-]?(?:engineering|design|tuning|templates?)|\bprompts\b"),
    ("LLM APIs",
     r"\bopenai\b|\banthropic\b|\bclaude\b|\bgemini\b|\bgpt[\s\-]?\d|\bchatgpt\b|\bllama\b"
     r"|\bmistral\b|azure[\s\-]openai|\bbedrock\b|vertex[\s\-]ai"),
    ("AI frameworks",
     r"\blangchain\b|\blanggraph\b|llama[\s\-]?index|hugging[\s\-]?face|\bautogen\b"
     r"|\bcrewai\b|model[\s\-]context[\s\-]protocol"),
    ("conversational AI", r"\bchat[\s\-]?bots?\b|conversational[\s\-]ai|\bcopilots?\b"),
    ("model serving",
     r"\binference\b|model[\s\-]?(?:serving|deployment|evaluation)|\bevals?\b"),
    ("AI features",
     r"\b(?:ai|ml|llm)[\s\-]?(?:features?|applications?|capabilit(?:y|ies)|assistants?"
     r"|workflows?|integrations?|models?|pipelines?|systems?)\b|\bai/ml\b"),
]

# Of each term, the words one of which stands in every match of its pattern (a few
# letters where a pattern holds no whole word). Kept in step with the patterns above.
DESCRIPTION_ANCHORS = {
    "machine learning": ["machine"],
    "deep learning": ["deep"],
    "LLMs": ["llm", "language"],
    "PyTorch": ["pytorch"],
    "TensorFlow": ["tensorflow"],
    "JAX": ["jax"],
    "scikit-learn": ["scikit", "sklearn"],
    "model training": ["train"],
    "fine-tuning": ["fine"],
    "NLP": ["nlp", "natural"],
    "computer vision": ["computer"],
    "MLOps": ["mlops"],
    "RAG": ["rag", "retrieval"],
    "embeddings": ["embedding", "vector"],
    "reinforcement learning": ["reinforcement"],
    "data science": ["scien"],
    "feature engineering": ["feature"],
    "neural networks": ["neural"],
    "transformers": ["transformer"],
    "CUDA": ["cuda"],
    "generative AI": ["gen"],
    "ML engineering": ["ml"],
    "AI agents": ["agent"],
    "prompt engineering": ["prompt"],
    "LLM APIs": ["openai", "anthropic", "claude", "gemini", "gpt", "llama", "mistral", "azure",
                 "bedrock", "vertex"],
    "AI frameworks": ["langchain", "langgraph", "llama", "hugging", "autogen", "crewai",
                      "protocol"],
    "conversational AI": ["bot", "conversational", "copilot"],
    "model serving": ["inference", "model", "eval"],
    "AI features": ["feature", "application", "capabilit", "assistant", "workflow",
                    "integration", "model", "pipeline", "system", "ai/ml"],
}

# --- Fixed values: identity ---------------------------------------------------

COMPANY_WORDS = [
    "inc", "incorporated", "llc", r"l\.l\.c", "ltd", "limited", "corp", "corporation", "co",
    "company", "plc", "gmbh", "ag", "sa", "bv", "nv", "pty", "labs?", "technologies",
    "technology", "holdings", "group", "solutions", "systems", "canada", "usa",
    "international", "global",
]
COMPANY_ALIASES = {"bankofmontreal": "bmo"}
TITLE_NOISE = [
    r"\b(?:winter|summer|fall|autumn|spring)\b[\s\-,]*(?:20)?\d{2,4}",
    r"\b[wsf](?:20)?2\d\b",
    r"\b20\d{2}\b",
    r"\b(?:req|job|jr|r)[\s\-#]?\d{4,}\b",
    r"\b\d{5,}\b",
    r"\b(?:remote|hybrid|onsite|on[\s\-]site)\b",
    r"\b(?:\d{1,2}\s*(?:month|mo|week|wk)s?)\b",
    r"\b(?:canada|usa|united states|toronto|vancouver|montreal|ottawa|waterloo)\b",
]
TITLE_FOLDS = [
    (r"\bco[\s\-]?op(?:erative)?(?:\s+education)?\b", " coop "),
    (r"\binternship\b", " intern "),
    (r"\bnew\s*grad(?:uate)?\b", " newgrad "),
]
UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
REQ_GREENHOUSE = r"[?&]gh_jid=(\d+)"
REQ_WORKDAY = r"_([A-Z]{1,4}-?\d{3,})(?:-\d{1,2})?/?$"
REQ_PATH = r"/(?:jobs?|postings?|positions?)/(\d{4,})(?:[/?#\-]|$)"

# --- Fixed values: boards, hosts and links --------------------------------------

TOKEN_NOISE = [
    "www", "jobs", "job", "careers", "career", "api", "app", "apply", "embed", "static",
    "assets", "cdn", "js", "css", "images", "img", "en", "en-us", "search", "index", "home",
    "about", "login", "signup", "help", "support",
]
SHORTENER_HOSTS = [
    "go.vansh.nyc", "bit.ly", "tinyurl.com", "t.co", "ow.ly", "rebrand.ly", "cutt.ly",
    "short.gy", "shorturl.at", "tiny.cc", "is.gd",
]
DENIED_HOSTS = [
    "zapply.jobs", "simplify.jobs", "google.com", "linkedin.com", "indeed.com", "indeed.ca",
    "glassdoor.com", "glassdoor.ca", "github.com", "careerpuck.com", "wellfound.com",
    "workatastartup.com", "joinhandshake.com", "amazon.jobs", "bit.ly", "forms.gle",
    "notion.site", "lnkd.in",
] + SHORTENER_HOSTS
DENIED_BOARD_WORDS = ["prolific", "welo", "general dynamics", "invisible", "internshiplist"]
AGGREGATOR_PREFIXES = ["tracker:", "getro:", "consider:"]
COUNTRY_SCOPED_PLATFORMS = ["jibe", "eightfold", "getro"]

ORACLE_HOST = r"([a-z0-9\-]+\.fa(?:\.[a-z0-9\-]+)*\.oraclecloud\.com)"
ORACLE_SITE = r"/hcmUI/CandidateExperience/[A-Za-z\-]+/sites/([A-Za-z0-9_]+)"
LOCALE = r"(?:[a-z]{2}-[A-Z]{2}/)?"
WORKDAY_POSTING = (r"https?://([a-z0-9\-]+)\.(wd\d+)\.myworkdayjobs\.com/" + LOCALE
                   + r"([A-Za-z0-9_\-]+)/job/")
WORKDAY_SITE_POSTING = (r"https?://(wd\d+)\.myworkdaysite\.com/" + LOCALE
                        + r"recruiting/([a-z0-9\-]+)/([A-Za-z0-9_\-]+)/job/")
ORACLE_POSTING = r"(?i)https?://" + ORACLE_HOST + ORACLE_SITE + r"/job/"
EIGHTFOLD_POSTING = r"(?i)https?://([a-z0-9\-]+)\.eightfold\.ai/careers/job/\d+"
JIBE_POSTING = r"(?i)https?://([a-z0-9.\-]+)/(?:[a-z\-]+/)?jobs/\d+\?(?:[^#]*&)?icims=1"
ICIMS_POSTING = r"(?i)https?://([a-z0-9\-]+\.icims\.com)/jobs/\d+"
SUCCESSFACTORS_POSTING = r"(?i)https?://([a-z0-9.\-]+)/job/[^/?#]+/\d{6,}/"
# Posting URLs whose board token is one slug, in matching order.
SLUG_POSTINGS = [
    ("ashby", r"(?i)jobs\.ashbyhq\.com/([A-Za-z0-9_.\-]+)/[0-9a-f\-]{8,}"),
    ("greenhouse",
     r"(?i)(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/([A-Za-z0-9_\-]+)/jobs/\d+"),
    ("greenhouse", r"(?i)greenhouse\.io/embed/job_app\?(?:[^#]*&)?for=([A-Za-z0-9_\-]+)"),
    ("lever", r"(?i)jobs\.lever\.co/([A-Za-z0-9_\-]+)/[0-9a-f\-]{8,}"),
    ("smartrecruiters", r"(?i)jobs\.smartrecruiters\.com/([A-Za-z0-9_\-]+)/\d+"),
    ("workable", r"(?i)apply\.workable\.com/([A-Za-z0-9_\-]+)/j/"),
    ("bamboohr", r"(?i)([A-Za-z0-9\-]+)\.bamboohr\.com/careers/\d+"),
    ("jazzhr", r"(?i)([A-Za-z0-9\-]+)\.applytojob\.com/apply/"),
    ("rippling", r"(?i)ats\.rippling\.com/([A-Za-z0-9_\-]+)/jobs/"),
    ("recruitee", r"(?i)([A-Za-z0-9\-]+)\.recruitee\.com/o/"),
    ("teamtailor", r"(?i)([A-Za-z0-9\-]+(?:\.na)?)\.teamtailor\.com/jobs/\d+"),
    ("breezy", r"(?i)([A-Za-z0-9\-]+)\.breezy\.hr/p/"),
    ("personio", r"(?i)([A-Za-z0-9\-]+)\.jobs\.personio\.(?:de|com)/job/\d+"),
]
# What stands, in small letters, in every link that a posting pattern matches. Kept in step
# with the patterns above.
BOARD_ANCHORS = {
    WORKDAY_POSTING: ".myworkdayjobs.com/",
    WORKDAY_SITE_POSTING: ".myworkdaysite.com/",
    ORACLE_POSTING: ".oraclecloud.com/hcmui/candidateexperience/",
    EIGHTFOLD_POSTING: ".eightfold.ai/careers/job/",
    JIBE_POSTING: "icims=1",
    ICIMS_POSTING: ".icims.com/jobs/",
    SUCCESSFACTORS_POSTING: "/job/",
    **dict(zip([pattern for _, pattern in SLUG_POSTINGS], [
        "jobs.ashbyhq.com/", ".greenhouse.io/", "greenhouse.io/embed/job_app?", "jobs.lever.co/",
        "jobs.smartrecruiters.com/", "apply.workable.com/", ".bamboohr.com/careers/",
        ".applytojob.com/apply/", "ats.rippling.com/", ".recruitee.com/o/",
        ".teamtailor.com/jobs/", ".breezy.hr/p/", ".jobs.personio."], strict=True)),
}
# Signatures a careers page or its URL carries, as (platform, pattern).
SIGNATURES = [
    ("ashby",
     r"(?:jobs\.ashbyhq\.com|api\.ashbyhq\.com/posting-api/job-board)/([A-Za-z0-9_.\-]+)"),
    ("greenhouse",
     r"(?:boards|job-boards)\.greenhouse\.io/(?:embed/job_board\?for=)?([A-Za-z0-9_\-]+)"),
    ("greenhouse", r"boards-api\.greenhouse\.io/v1/boards/([A-Za-z0-9_\-]+)"),
    ("lever", r"(?:jobs\.lever\.co|api\.lever\.co/v0/postings)/([A-Za-z0-9_\-]+)"),
    ("smartrecruiters",
     r"(?:jobs|careers|api)\.smartrecruiters\.com/(?:v1/companies/)?([A-Za-z0-9_\-]+)"),
    ("workable", r"apply\.workable\.com/(?:api/v1/widget/accounts/)?([A-Za-z0-9_\-]+)"),
    ("recruitee", r"([A-Za-z0-9_\-]+)\.recruitee\.com"),
    ("teamtailor", r"([A-Za-z0-9_\-]+)\.teamtailor\.com"),
    ("breezy", r"([A-Za-z0-9_\-]+)\.breezy\.hr"),
    ("personio", r"([A-Za-z0-9_\-]+)\.jobs\.personio\.(?:de|com)"),
    ("workday",
     r"([a-z0-9\-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[a-z\-]+/)?([A-Za-z0-9_\-]+)"),
    ("oracle", ORACLE_HOST + ORACLE_SITE),
    ("eightfold", r"([a-z0-9\-]+)\.eightfold\.ai"),
    ("jibe", r"(?:app|assets)\.jibecdn\.com"),
    ("icims", r"([A-Za-z0-9_\-]+)\.icims\.com"),
    ("successfactors", r"rmkcdn\.successfactors\.com"),
    ("sapsf", r"(?<![\w\-])(?!rmkcdn\.)([A-Za-z0-9_\-]+)\.(?:successfactors|sapsf)\.(?:com|eu)"),
    ("bamboohr", r"([A-Za-z0-9_\-]+)\.bamboohr\.com"),
    ("jazzhr", r"([A-Za-z0-9_\-]+)\.applytojob\.com"),
    ("rippling", r"ats\.rippling\.com/(?:api/v2/board/)?([A-Za-z0-9_\-]+)"),
]
NO_LISTING_PLATFORMS = ["sapsf"]
GENERIC_PAGE_TITLE = (
    r"(?i)^(?:careers?|jobs?|home|open\s+(?:roles|positions)|work\s+with\s+us|join\s+us|"
    r"opportunities|hiring|about|team|welcome)$"
)

# --- Fixed values: pages, sitemaps and trackers ---------------------------------

ANCHOR = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"'#]+)["'][^>]*>(.*?)</a>"""
NAV_LABEL = (
    r"(?i)^(?:students?|interns?|internships?|co-?ops?|new\s+grads?|graduates?|"
    r"early\s+careers?|early\s+talent|university|campus|programs?|opportunities|jobs|careers|"
    r"recent\s+grads|and|[\s,/&-])+(?:jobs|program|programs|opportunities)?$"
)
JOB_LINK = r"(?i)job|career|position|opening|posting|apply|vacanc|req"
JSONLD_SCRIPT = (
    r"""(?is)<script[^>]+type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
)
SITEMAP_JOB_PATH = (
    r"(?i)/(?:jobs?|careers?|positions?|openings?|postings?|opportunit(?:y|ies)|"
    r"vacanc(?:y|ies)|requisitions?|job-?details?)/"
)
SITEMAP_CHILD = r"(?i)job|career|position|opening|posting|vacanc|requisition"
OG_TITLE = r"""(?i)<meta[^>]+property=["']og:title["'][^>]*content=["']([^"']+)"""
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"
META_REFRESH = (
    r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]*content=["'][^"']*?url=([^"'>\s]+)"""
)
SEASON_PLACEHOLDERS = ["n/a", "na", "tbd", "tba", "-", "none", "unknown", "null"]
TRACKER_BRANCHES = ["dev", "main", "master"]
COLUMN_ALIASES = {
    "company": ["company", "employer", "organization"],
    "title": ["role", "position", "title", "job"],
    "location": ["location", "city", "where"],
    "url": ["apply", "application", "link", "url", "posting"],
    "date": ["date", "posted", "age", "added", "when"],
    "details": ["detail", "term", "duration", "type", "season"],
}
CONTINUATION_MARKS = ["↳", "->", "&#8627;"]
IMAGE_URL = r"img\.shields\.io|i\.imgur\.com|\.(?:png|svg|jpe?g|gif|webp)(?:[?#]|$)"

# --- Fixed values: keys of a provider's record that later stages read ------------

LOCATION_KEYS = [
    "location", "locations", "locationsText", "offices", "city", "region", "allLocations",
    "secondaryLocations", "workplaceType", "isRemote", "remote",
]
CYCLE_KEYS = ["details", "terms", "term", "season", "commitment", "workType", "duration",
              "category"]
LABEL_KEYS = ["name", "text", "label", "city", "location", "title"]
