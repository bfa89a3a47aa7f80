"""Word lists, lookup tables, patterns and limits.

Everything here is data that results depend on, stated once and as text.
Operators turn it into literal maps, regular expressions or small dimension
tables; nothing here is logic.
"""

# --- Fixed values: company and title vocabulary -----------------------------

COMPANY_SUFFIXES = """
inc inc. llc ltd ltd. limited corp corp. corporation co co. company gmbh bv nv
plc pvt private pte sa ag technologies technology labs software systems
solutions group holdings india global worldwide international
""".split()

# Words that never identify a company on a page.
GENERIC_COMPANY_WORDS = """
inc llc ltd limited plc gmbh pvt private corp corporation co company
technologies technology labs software solutions systems group holdings the and
""".split()

LEGAL_SUFFIX_PATTERN = (
    r"\b(inc|llc|ltd|limited|plc|gmbh|pvt|private|corp|corporation|co|company|"
    r"technologies|technology|labs|software|solutions|systems|group|holdings)\b\.?"
)

# Removed from a title, in this order.
TITLE_NOISE = [
    r"\(.*?\)",
    r"\[.*?\]",
    r"\b(?:req(?:uisition)?\s*#?\s*\d+)\b",
    r"\bjob\s*id\s*:?\s*\w+\b",
    r"\b(?:full[- ]?time|part[- ]?time|contract|internship|permanent)\b",
    r"\b(?:remote|hybrid|on[- ]?site|onsite)\b",
    r"\b(?:m/f/d|f/m/d|m/w/d|d/f/m)\b",
    r"[-–—|,/]+\s*(?:remote|hybrid|bangalore|bengaluru|mumbai|delhi|gurgaon|noida|pune|"
    r"hyderabad|chennai|india|usa|uk|emea|apac)\b.*$",
]

# Rewritten in a title after the noise is gone, in this order.
TITLE_REWRITES = [
    (r"\bsr\b", "senior"),
    (r"\bjr\b", "junior"),
    (r"\bapm\b", "associate product manager"),
    (r"\bpm\b", "product manager"),
    (r"\bba\b", "business analyst"),
    (r"\bda\b", "data analyst"),
    (r"\bmgr\b", "manager"),
    (r"\bopsl?\b", "operations"),
    (r"\bai\s*ml\b", "ai"),
    (r"\bml\b", "machine learning"),
]

LOCATION_REMOTE_PATTERN = r"\b(remote|anywhere|work from home|wfh|distributed)\b"
LOCATION_INDIA_PATTERN = r"\b(india|in)\b"
LOCATION_REWRITES = [
    ("bengaluru", "bangalore"),
    ("gurugram", "gurgaon"),
    ("new delhi", "delhi"),
    ("bombay", "mumbai"),
    ("united states", "usa"),
    ("united states of america", "usa"),
    ("united kingdom", "uk"),
]

SENIORITY = {
    "intern": 0, "trainee": 0, "graduate": 0, "entry": 0,
    "junior": 1, "jr": 1, "associate": 1, "apm": 1, "analyst": 1,
    "mid": 2, "senior": 3, "sr": 3, "lead": 4, "staff": 4,
    "principal": 5, "head": 6, "director": 6, "vp": 7, "chief": 8,
}

# --- Fixed values: places ------------------------------------------------------

COUNTRIES = {
    "india": "in", "united states": "us", "usa": "us", "us": "us", "america": "us",
    "united kingdom": "gb", "uk": "gb", "britain": "gb", "england": "gb",
    "canada": "ca", "australia": "au", "germany": "de", "france": "fr",
    "netherlands": "nl", "singapore": "sg", "ireland": "ie", "spain": "es",
    "italy": "it", "poland": "pl", "brazil": "br", "mexico": "mx",
    "south africa": "za", "new zealand": "nz", "austria": "at",
    "switzerland": "ch", "belgium": "be",
}

# alias, display name, country
CITIES = [
    ("bangalore", "Bangalore", "in"),
    ("bengaluru", "Bangalore", "in"),
    ("hyderabad", "Hyderabad", "in"),
    ("mumbai", "Mumbai", "in"),
    ("bombay", "Mumbai", "in"),
    ("delhi", "Delhi", "in"),
    ("new delhi", "Delhi", "in"),
    ("ncr", "Delhi NCR", "in"),
    ("delhi ncr", "Delhi NCR", "in"),
    ("gurgaon", "Gurgaon", "in"),
    ("gurugram", "Gurgaon", "in"),
    ("noida", "Noida", "in"),
    ("pune", "Pune", "in"),
    ("chennai", "Chennai", "in"),
    ("kolkata", "Kolkata", "in"),
    ("ahmedabad", "Ahmedabad", "in"),
    ("jaipur", "Jaipur", "in"),
    ("kochi", "Kochi", "in"),
    ("coimbatore", "Coimbatore", "in"),
    ("indore", "Indore", "in"),
    ("chandigarh", "Chandigarh", "in"),
    ("trivandrum", "Trivandrum", "in"),
    ("thiruvananthapuram", "Trivandrum", "in"),
    ("san francisco", "San Francisco", "us"),
    ("sf", "San Francisco", "us"),
    ("bay area", "San Francisco Bay Area", "us"),
    ("new york", "New York", "us"),
    ("nyc", "New York", "us"),
    ("seattle", "Seattle", "us"),
    ("austin", "Austin", "us"),
    ("boston", "Boston", "us"),
    ("chicago", "Chicago", "us"),
    ("los angeles", "Los Angeles", "us"),
    ("denver", "Denver", "us"),
    ("atlanta", "Atlanta", "us"),
    ("san diego", "San Diego", "us"),
    ("washington dc", "Washington DC", "us"),
    ("london", "London", "gb"),
    ("manchester", "Manchester", "gb"),
    ("edinburgh", "Edinburgh", "gb"),
    ("dublin", "Dublin", "ie"),
    ("berlin", "Berlin", "de"),
    ("munich", "Munich", "de"),
    ("hamburg", "Hamburg", "de"),
    ("amsterdam", "Amsterdam", "nl"),
    ("paris", "Paris", "fr"),
    ("madrid", "Madrid", "es"),
    ("barcelona", "Barcelona", "es"),
    ("zurich", "Zurich", "ch"),
    ("warsaw", "Warsaw", "pl"),
    ("lisbon", "Lisbon", "pt"),
    ("singapore", "Singapore", "sg"),
    ("toronto", "Toronto", "ca"),
    ("vancouver", "Vancouver", "ca"),
    ("sydney", "Sydney", "au"),
    ("melbourne", "Melbourne", "au"),
    ("dubai", "Dubai", "ae"),
    ("tokyo", "Tokyo", "jp"),
    ("sao paulo", "São Paulo", "br"),
    ("mexico city", "Mexico City", "mx"),
    ("cape town", "Cape Town", "za"),
    ("tel aviv", "Tel Aviv", "il"),
]

REMOTE_TERMS = ["remote", "work from home", "wfh", "anywhere", "fully remote", "remote only"]
HYBRID_TERMS = ["hybrid", "onsite", "on-site", "in office", "in-office"]
LOOKS_REMOTE_TERMS = ["remote", "work from home", "anywhere"]

ADZUNA_COUNTRIES = "at au be br ca ch de es fr gb in it mx nl nz pl sg us za".split()

# --- Fixed values: roles and industries -------------------------------------

ROLE_ABBREVIATIONS = {
    "apm": "associate product manager",
    "pm": "product manager",
    "tpm": "technical program manager",
    "gpm": "group product manager",
    "sde": "software development engineer",
    "swe": "software engineer",
    "sre": "site reliability engineer",
    "ml engineer": "machine learning engineer",
    "ds": "data scientist",
    "ba": "business analyst",
    "qa": "quality assurance engineer",
    "ux": "user experience designer",
    "ui": "user interface designer",
    "hr": "human resources",
    "sdr": "sales development representative",
    "ae": "account executive",
    "csm": "customer success manager",
}

TITLE_EXPANSIONS = {
    "associate product manager": ["product manager", "apm", "product management associate"],
    "product manager": ["associate product manager", "product owner"],
    "software engineer": ["software development engineer", "backend engineer", "developer"],
    "data scientist": ["data science", "machine learning engineer"],
    "data analyst": ["business analyst", "analytics"],
    "product designer": ["ux designer", "product design"],
    "program manager": ["technical program manager", "project manager"],
}

INDUSTRY_TERMS = {
    "fintech": ["fintech", "payments", "banking", "financial services", "lending"],
    "healthtech": ["healthtech", "healthcare", "health tech", "medical", "biotech"],
    "edtech": ["edtech", "education", "learning", "e-learning"],
    "ecommerce": ["ecommerce", "e-commerce", "retail", "marketplace", "d2c"],
    "saas": ["saas", "b2b saas", "enterprise software"],
    "gaming": ["gaming", "games", "game studio"],
    "logistics": ["logistics", "supply chain", "delivery", "mobility"],
    "consulting": ["consulting", "advisory", "professional services"],
    "media": ["media", "entertainment", "streaming", "publishing"],
    "climate": ["climate", "cleantech", "sustainability", "renewable"],
    "ai": ["ai", "artificial intelligence", "machine learning", "llm", "genai"],
    "cybersecurity": ["cybersecurity", "security", "infosec"],
    "traveltech": ["travel", "traveltech", "hospitality"],
    "agritech": ["agritech", "agriculture", "farming"],
}

# Capitalised words after "at" that are not a company.
NOT_A_COMPANY = """
least most level entry senior junior any all startups startup companies company
firms mnc mncs product tech the a an top big small early stage unicorn unicorns
faang
""".split()

# --- Fixed values: wording of free-text requests ----------------------------

REQUEST_EXPERIENCE = [
    r"(?i)\b(?:for|with|requiring|needing|having|of)?\s*"
    r"(?:\d{1,2}\s*(?:-|–|—|to|~)\s*\d{1,2}|\d{1,2}\s*\+?)\s*"
    r"(?:years?|yrs?)(?:\s+of)?(?:\s+(?:work\s+)?experience)?",
    r"(?i)\b(?:for\s+)?(?:freshers?|fresh\s+graduates?|new\s+grads?|entry[\s\-]?level|"
    r"early\s+career|campus\s+hires?)\b",
]
REQUEST_EXCLUSION = (
    r"(?iU)\b(?:not|no|except|excluding|exclude|without|avoid)\s+([\w .'’\-]+?)(?=\s*(?:,|\.|;|$|\band\b))"
)
REQUEST_QUOTED = r"[\"“”']([^\"“”']{2,60})[\"“”']"
REQUEST_KEYWORD = (
    r"(?iU)\b(?:with|using|skills?(?:\s+in)?|knowing|experienced?\s+in|proficient\s+in)\s+"
    r"([\w+#.]+(?:\s*(?:,|and|&|/|\+)\s*[\w+#.]+)*)"
)
REQUEST_LOCATION = (
    r"(?i)\b(?:in|at|near|around|based\s+in|located\s+in|across)\s+"
    r"([A-Za-z][A-Za-z .'’\-]*(?:\s*(?:,|and|&|/|\+|or)\s*[A-Za-z][A-Za-z .'’\-]*)*)"
)
REQUEST_COMPANY = (
    r"(?U)\b(?:at|with|for)\s+((?:[A-Z][\w&.'’\-]*)(?:\s+[A-Z][\w&.'’\-]*){0,3}"
    r"(?:\s*(?:,|and|&|/)\s*[A-Z][\w&.'’\-]*(?:\s+[A-Z][\w&.'’\-]*){0,3})*)"
)
REQUEST_LIST_BREAK = r"(?i)\s*(?:,|/|\+|&|\band\b|\bor\b)\s*"
# Removed, in this order, before what is left counts as the title.
REQUEST_FILLER = [
    r"(?i)^\s*(?:please\s+)?(?:can\s+you\s+)?(?:help\s+me\s+)?"
    r"(?:find|search(?:\s+for)?|look(?:ing)?\s+for|show(?:\s+me)?|get(?:\s+me)?|"
    r"list|fetch|discover|i\s+(?:want|need|am\s+looking\s+for))\s+",
    r"(?i)\b(?:roles?|jobs?|positions?|openings?|opportunit(?:y|ies)|vacanc(?:y|ies)|posting?s?|listings?)\b",
    r"(?i)\b(?:for|in|at|with|of|the|a|an|any|please|me)\b",
    r"(?U)[^\w\s&/+#.'’\-]",
]

# --- Fixed values: experience ---------------------------------------------------

EXPERIENCE_RANGE = r"(?i)\b([0-9]{1,2})\s*(?:-|–|—|to|~)\s*([0-9]{1,2})\s*\+?\s*(?:\+)?\s*(?:years?|yrs?|y)\b"
EXPERIENCE_MAXIMUM = (
    r"(?i)\b(?:up\s+to|under|less\s+than|below|max(?:imum)?(?:\s+of)?)\s*([0-9]{1,2})\s*(?:years?|yrs?)\b"
)
EXPERIENCE_PLUS = r"(?i)\b([0-9]{1,2})\s*(?:\+|plus|or\s+more)\s*(?:years?|yrs?)\b"
EXPERIENCE_MINIMUM = (
    r"(?i)\b(?:(?:at\s+least|minimum(?:\s+of)?|min\.?|more\s+than|over)\s*)?"
    r"([0-9]{1,2})\s*(?:\+|plus|or\s+more)?\s*(?:years?|yrs?)\b"
)
# First match decides the level.
EXPERIENCE_LEVELS = [
    (r"(?i)\b(interns?|internships?|trainees?|apprentices?)\b", "INTERNSHIP"),
    (
        r"(?i)\b(freshers?|fresh\s+graduates?|new\s+grads?|graduate\s+(?:roles?|programmes?|programs?)|"
        r"entry[\s\-]?level|campus\s+hires?|0\s*years?)\b",
        "ENTRY",
    ),
    (r"(?i)\b(junior|associate|early\s+career|jr\.?)\b", "ENTRY"),
    (r"(?i)\b(mid[\s\-]?level|intermediate)\b", "MID"),
    (r"(?i)\b(senior|sr\.?|staff)\b", "SENIOR"),
    (r"(?i)\b(lead|principal|head\s+of|manager\s+of\s+managers)\b", "LEAD"),
    (r"(?i)\b(director|vp|vice\s+president|chief|c-level|cxo)\b", "EXECUTIVE"),
]
LEVEL_YEARS = {
    "INTERNSHIP": (0.0, 1.0),
    "ENTRY": (0.0, 2.0),
    "MID": (2.0, 5.0),
    "SENIOR": (5.0, 10.0),
    "LEAD": (8.0, 15.0),
    "EXECUTIVE": (12.0, 40.0),
}
MAX_YEARS = 40.0

# --- Fixed values: URLs and networks ----------------------------------------

TRACKING_PARAM_PATTERN = (
    r"(?i)^(utm_|gh_src|src|source|ref|referrer|trk|trkCampaign|lever-origin|"
    r"lever-source|gclid|fbclid|mc_cid|mc_eid)"
)
THIRD_PARTY_HOSTS = """
greenhouse.io lever.co ashbyhq.com workable.com myworkdayjobs.com
smartrecruiters.com bamboohr.com jobvite.com recruitee.com adzuna. themuse.com
remotive.com arbeitnow.com jobicy.com usajobs.gov linkedin.com indeed.com glassdoor.
""".split()

ALLOWED_PORTS = [80, 443, 8000, 8080, 8443]
BLOCKED_HOSTNAMES = """
localhost localhost.localdomain ip6-localhost ip6-loopback metadata
metadata.google.internal instance-data metadata.goog
""".split()
BLOCKED_SUFFIXES = [".local", ".localdomain", ".internal", ".cluster.local"]
METADATA_ADDRESSES = ["169.254.169.254", "fd00:ec2::254", "100.100.100.200"]
BLOCKED_NETWORKS = """
100.64.0.0/10 198.18.0.0/15 192.0.0.0/24 192.0.2.0/24 198.51.100.0/24
203.0.113.0/24 240.0.0.0/4 64:ff9b::/96 100::/64 2001:db8::/32
""".split()
# Loopback, private, link-local, multicast, reserved and unspecified space.
NON_GLOBAL_NETWORKS = """
0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16
224.0.0.0/4 255.255.255.255/32
::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 2001::/23 2002::/16 3fff::/20
4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6
fc00::/7 fe00::/9 fe80::/10 ff00::/8
""".split()
# Globally routable blocks inside 2001::/23.
GLOBAL_EXCEPTIONS = """
2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28
""".split()
MAX_URL_LENGTH = 2048

# --- Fixed values: fetching ------------------------------------------------------

BLOCKING_STATUSES = [401, 402, 403, 407, 429, 451]
RETRYABLE_STATUSES = [408, 500, 502, 503, 504]
GONE_STATUSES = [404, 410]
MAX_RESPONSE_BYTES = 3_000_000

# --- Fixed values: e-mail and contacts --------------------------------------

EMAIL_PATTERN = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
ROLE_LOCALPARTS = """
careers jobs hiring recruiting recruitment talent hr people work join apply
jobapplications team info hello contact support help admin sales press media
legal privacy security noreply no-reply donotreply webmaster postmaster abuse
""".split()
TALENT_LOCALPARTS = "careers jobs hiring recruiting recruitment talent hr people join apply".split()
PERSONAL_DOMAINS = """
gmail.com googlemail.com yahoo.com yahoo.co.in hotmail.com outlook.com live.com
aol.com icloud.com me.com mail.com protonmail.com proton.me yandex.com gmx.com
zoho.com rediffmail.com
""".split()

# First match decides why a person is worth contacting.
CONTACT_TITLES = [
    (
        r"(?i)\b(technical recruiter|tech recruiter|product recruiter|engineering recruiter|"
        r"campus recruiter|university recruiter|gtm recruiter|design recruiter)\b",
        "FUNCTION_RECRUITER",
    ),
    (
        r"(?i)\b(talent acquisition|talent partner|talent lead|talent manager|recruiting"
        r"(?: manager| lead| partner)?|recruitment(?: manager| lead| partner)?|recruiter|"
        r"sourcer|head of talent|head of people|people operations|people partner|"
        r"hr business partner|hrbp)\b",
        "TALENT_ACQUISITION",
    ),
    (r"(?i)\b(hiring manager|engineering manager|head of engineering)\b", "HIRING_MANAGER"),
    (
        r"(?i)\b(vp of |vice president|director of|head of|chief |group product manager|"
        r"team lead|tech lead|principal)\b",
        "TEAM_LEAD",
    ),
]
PERSON_NAME_PATTERN = r"^[A-Z][\w'’\-]+(?:\s+[A-Z][\w'’\-]+){1,3}$"
CAREER_PATHS = [
    "/careers", "/jobs", "/about/team", "/team", "/about", "/company/team", "/people", "/contact",
]

# --- Fixed values: posting checks --------------------------------------------

CLOSED_PHRASES = [
    "no longer accepting applications",
    "no longer available",
    "no longer active",
    "this job is closed",
    "this position is closed",
    "position has been filled",
    "this role has been filled",
    "job posting is closed",
    "applications are closed",
    "we are no longer hiring",
    "this opening has expired",
    "job has expired",
    "posting has expired",
    "vacancy is closed",
    "this job posting is no longer",
    "sorry, this job is not available",
    "the job you are looking for is not available",
    "job not found",
    "page not found",
    "404 - not found",
]
LISTING_HINTS = ["search results", "all jobs", "browse jobs", "current openings"]

# --- Fixed values: job boards ----------------------------------------------------

# platform, payload address, public address, source, hosts
BOARD_PLATFORMS = [
    (
        "greenhouse",
        "https://boards-api.greenhouse.io/v1/boards/{token}/jobs?content=true",
        "https://boards.greenhouse.io/{token}",
        "GREENHOUSE",
        ["greenhouse.io", "job-boards.greenhouse.io", "boards.greenhouse.io"],
    ),
    (
        "lever",
        "https://api.lever.co/v0/postings/{token}?mode=json",
        "https://jobs.lever.co/{token}",
        "LEVER",
        ["lever.co", "jobs.lever.co"],
    ),
    (
        "ashby",
        "https://api.ashbyhq.com/posting-api/job-board/{token}?includeCompensation=true",
        "https://jobs.ashbyhq.com/{token}",
        "ASHBY",
        ["ashbyhq.com", "jobs.ashbyhq.com"],
    ),
]

# name, label, settings it needs, carries only remote roles, countries it covers
JOB_SOURCES = [
    ("company_boards", "Company job boards", [], False, None),
    ("adzuna", "Adzuna", ["adzuna_app_id", "adzuna_app_key"], False, ADZUNA_COUNTRIES),
    ("themuse", "The Muse", [], False, None),
    ("remotive", "Remotive", [], True, None),
    ("arbeitnow", "Arbeitnow", [], False, None),
    ("jobicy", "Jobicy", [], True, None),
    ("usajobs", "USAJobs", ["usajobs_api_key", "usajobs_user_agent"], False, ["us"]),
]

# --- Fixed values: enumerations ---------------------------------------------

SOURCE_LABELS = {
    "ADZUNA": "Adzuna",
    "THE_MUSE": "The Muse",
    "REMOTIVE": "Remotive",
    "ARBEITNOW": "Arbeitnow",
    "JOBICY": "Jobicy",
    "USAJOBS": "USAJobs",
    "GREENHOUSE": "Greenhouse (company board)",
    "LEVER": "Lever (company board)",
    "ASHBY": "Ashby (company board)",
    "CAREER_PAGE": "Company career page",
    "JOB_POSTING_CONTACT": "Named on the job posting",
    "COMPANY_TEAM_PAGE": "Company team page",
    "COMPANY_CAREERS_PAGE": "Company careers page",
    "DIRECTORY_SEARCH_LINK": "Directory search link",
    "MANUAL_ENTRY": "Entered by you",
}
FIRST_PARTY_SOURCES = ["GREENHOUSE", "LEVER", "ASHBY", "CAREER_PAGE"]

VALIDATION_LABELS = {
    "PENDING": "Not yet checked",
    "VALID": "Verified active",
    "LIKELY_VALID": "Reachable, active",
    "UNVERIFIED": "Could not confirm",
    "EXPIRED": "Closed or expired",
    "BROKEN": "Link does not work",
    "DUPLICATE": "Duplicate posting",
    "IRRELEVANT": "Does not match the search",
    "MISMATCH": "Posting belongs to another company",
}
DISPLAYABLE_STATUSES = ["VALID", "LIKELY_VALID", "UNVERIFIED"]
CONFIRMED_STATUSES = ["VALID", "LIKELY_VALID"]

# Best first; the position is the rank.
CONTACT_ROLE_LABELS = {
    "FUNCTION_RECRUITER": "Recruiter for this function",
    "TALENT_ACQUISITION": "Talent acquisition",
    "HIRING_MANAGER": "Hiring manager",
    "TEAM_LEAD": "Team / functional lead",
    "TALENT_ALIAS": "Company talent inbox",
    "SEARCH_LINK": "Directory search",
}
IMPERSONAL_ROLES = ["TALENT_ALIAS", "SEARCH_LINK"]

EMAIL_STATUS_LABELS = {
    "NONE": "No public address found",
    "PUBLISHED_ATTRIBUTED": "Published and attributed to this person",
    "PUBLISHED_TEAM_ALIAS": "Published company address (not personal)",
    "USER_PROVIDED": "Added by you",
}

APPLICATION_STATUSES = ["SAVED", "APPLIED", "OUTREACH_SENT", "INTERVIEW", "REJECTED", "OFFER", "CLOSED"]
CLOSED_APPLICATION_STATUSES = ["REJECTED", "CLOSED"]
APPLIED_STATUSES = ["APPLIED", "OUTREACH_SENT", "INTERVIEW", "REJECTED", "OFFER"]

OUTREACH_LABELS = {
    "NOT_STARTED": "Not started",
    "EMAIL_SENT": "Email sent",
    "LINKEDIN_SENT": "LinkedIn message sent",
    "REPLIED": "They replied",
    "NO_RESPONSE": "No response",
}

# Status words used by e-mail checking vendors.
VENDOR_EMAIL_STATUSES = {
    "valid": "valid",
    "deliverable": "valid",
    "ok": "valid",
    "invalid": "invalid",
    "undeliverable": "invalid",
    "risky": "risky",
    "accept_all": "risky",
    "accept-all": "risky",
    "catch_all": "risky",
    "unknown": "unknown",
    "error": "unknown",
}
VENDOR_DEFAULT_CONFIDENCE = {"valid": 0.9, "risky": 0.5, "invalid": 0.0, "unknown": 0.0}

# --- Fixed values: scoring and limits ----------------------------------------

SCORE_WEIGHTS = {
    "title": 45.0, "location": 20.0, "experience": 15.0, "keywords": 10.0, "company": 5.0, "industry": 5.0,
}
MIN_TITLE_SIMILARITY = 0.20
GATE_SCORE = 15.0
MIN_RELEVANCE = 35.0
RESULT_LIMIT = 40
MAX_RESULT_LIMIT = 120
