"""Word lists, lookup tables and patterns that results depend on.

They are public facts of the domain (hosts, parameters, phrases) and must keep
exactly these values; everything else in the package is free to change.
Patterns are written so that Java, Python and RE2 read them alike.
"""

# -- messages: phrases by what they tell -----------------------------------------
ALERT_SUBJECT = (
    r"(?i)(job alert|jobs? for you|your job search|new jobs?|job match(?:es)?|"
    r"\d+\s+new\s+(job|opportunit)|jobs? matching|recommended for you|"
    r"your job alert|hiring now|new opportunities|still available|"
    r"you would be a great fit|career alerts?|potential roles|"
    r"talent community|job match has arrived|"
    r"we.?ve matched|matched .{0,40}to your profile|"
    r"(role|roles|opportunit(?:y|ies)) .{0,40}(match|for you)|"
    r"looks like a (match|great fit)|this (job|role) is a match|job feed|"
    r"job recommendations?|opportunit(?:y|ies) for you)"
)
INTERVIEW = (
    r"(?i)(schedule (an? )?(interview|call|chat)|interview (invitation|request|scheduled|confirm)|"
    r"phone screen|screening call|availability (for|to)|book a time|calendly|"
    r"next (round|steps?) (of|in) (the )?interview|meet with the team|invite you to interview)"
)
ASSESSMENT = (
    r"(?i)(coding (challenge|assessment|test)|online assessment|take[- ]home|hackerrank|codesignal|"
    r"codility|karat|technical assessment|skills? test)"
)
VIDEO_STEP = (
    r"(?i)(record (a |your )?(short )?video|video (submission|response|introduction|interview)|"
    r"one[- ]way (video )?interview|on[- ]demand interview|asynchronous interview|"
    r"hirevue|spark ?hire|willo\.video|vidcruiter|myinterview|talview)"
)
NEXT_STEP = (
    r"(?i)(complete (the |your )?(following|next) steps?|"
    r"next step.{0,80}(please|kindly|record|complete|submit|upload|fill)|"
    r"(please|kindly) (complete|submit|provide|upload|fill in|fill out|answer)[^.\n]{0,60}"
    r"(form|questionnaire|survey|document|profile|details|information|questions)|"
    r"background check|reference check|work authori[sz]ation form|"
    r"screening questions|pre[- ]screen(ing)? questions|"
    r"additional information (is )?(needed|required))"
)
SUBMITTED = (
    r"(?i)(successfully (submitted|applied|sent)|application (was |has been )?(received|submitted|sent|complete)|"
    r"we (have )?received your application|thank(s| you)?( very much)? for (applying|your application)|"
    r"your application (has been|was) (received|submitted|sent)|application confirmation|"
    r"your application was sent)"
)
OFFER = r"(?i)(offer letter|pleased to offer|job offer|we are excited to offer)"
REJECTION = (
    r"(?i)(not (moving|move) forward|unfortunately[^.]{0,80}(not|other candidates)|"
    r"decided to (proceed|move forward) with other|no longer under consideration|"
    r"we will not be|position has been filled|pursuing other candidates)"
)
APPLIED = (
    r"(?i)(thank(s| you)?( very much)? for (applying|your (interest|application))|"
    r"thank(s| you)? for taking the time to apply|"
    r"thank(s| you)? for taking the first steps|"
    r"first steps toward[s]? a career|"
    r"application (was )?(received|submitted|sent|complete)|successfully (submitted|applied|sent)|"
    r"we (have )?received your application|your application (to|for|is|has|was sent)|"
    r"application status)"
)
RECRUITER = (
    r"(?i)(reaching out|came across your (profile|resume)|i(’|')?m a (technical )?recruiter|"
    r"we have an (urgent )?(opening|requirement|opportunity)|is this (role|position) of interest|"
    r"are you (open|available|interested) (to|for|in)|hotlist|c2c|w2 (only|position)|"
    r"corp to corp|would you be interested|share your (updated )?resume|your candidacy)"
)
URGENT = (
    r"(?i)(today|tomorrow|asap|urgent|by (eod|end of day)|within 24 hours|expires|deadline|"
    r"respond by|last (date|day))"
)
NOREPLY = r"(?i)(no-?reply|do-?not-?reply|notification|alerts?@|mailer|bounce)"
MARKETING = (
    r"(?i)(newsletter|webinar|unsubscribe from all|sale ends|% off|course|masterclass|"
    r"upgrade to premium|invoice|receipt|statement|verify your (email|account)|"
    r"security alert|password)"
)
WEBINAR = r"(?i)\b(webinar|workshop|masterclass|office hours|info session)\b"
NEWSLETTER = r"(?i)\b(newsletter|weekly digest|roundup|unsubscribe from all)\b"
SECURITY = (
    r"(?i)(security alert|verify your (email|account)|password (reset|changed)|"
    r"unusual sign[- ]in|new (login|sign[- ]in)|two[- ]factor)"
)
LOGIN_CODE = (
    r"(?i)(verification code|security code|one[- ]time (?:pass)?code|one[- ]time password|\botp\b|"
    r"(?:sign[- ]?in|login|authentication) code|passcode|"
    r"your code is\s*\d{4,8}|enter (this |the |the provided |provided )?code|"
    r"confirm your identity|verify your identity|"
    r"multi[- ]factor authentication|"
    r"2[- ]step verification|magic link to (?:sign|log) in)"
)
#: Labels in their order.
CATEGORIES = (
    "job_alert", "recruiter_outreach", "interview_invite", "assessment", "next_step", "offer", "rejection", "application_update", "other",
)
#: Texts of a message's start that rules read, by what for.
RULE_TEXT = 6000
FIELD_TEXT = 4000

# -- postings: fields in free text -----------------------------------------------
EMPLOYMENT = (
    r"(?i)\b(full[- ]?time|part[- ]?time|contract(?:or)?|w2(?:\s+only)?|c2c|"
    r"corp[- ]to[- ]corp|1099|internship|temporary|seasonal)\b"
)
EMPLOYMENT_LABELS = {
    "full time": "Full-Time",
    "full-time": "Full-Time",
    "part time": "Part-Time",
    "part-time": "Part-Time",
    "contractor": "Contract",
    "contract": "Contract",
    "w2": "W2 Contract",
    "w2 only": "W2 Contract",
    "c2c": "C2C",
    "corp-to-corp": "C2C",
    "corp to corp": "C2C",
    "1099": "1099",
    "internship": "Internship",
    "temporary": "Temporary",
    "seasonal": "Seasonal",
}
EMPLOYMENT_CODES = {
    "FULL_TIME": "Full-Time",
    "PART_TIME": "Part-Time",
    "CONTRACTOR": "Contract",
    "TEMPORARY": "Temporary",
    "INTERN": "Internship",
    "VOLUNTEER": "Volunteer",
    "OTHER": "Other",
}
SALARY = (
    r"(?i)(\$\s?\d{2,3}(?:,\d{3})+(?:\s*[-–—to]+\s*\$?\s?\d{2,3}(?:,\d{3})+)?(?:\s*(?:k|K))?"
    r"|\b\d{2,3}(?:\.\d+)?\s*[-–—to]+\s*\d{2,3}(?:\.\d+)?\s*k(?:\s*(?:usd|usd/yr|/year|per year))?"
    r"|\$\s?\d{2,3}(?:\.\d+)?\s*(?:-|to|–|—)\s*\$?\s?\d{2,3}(?:\.\d+)?\s*k"
    r"|\$\s?\d{2,4}(?:\.\d{2})?\s*(?:/|per)\s*(?:hour|hr|year|yr|annum))"
)
VISA_NO = (
    r"(?i)(will not sponsor|no sponsorship|unable to sponsor|cannot sponsor|"
    r"does not sponsor|do not sponsor|not sponsor|"
    r"not eligible for (?:any )?(?:visa |work authorization |immigration )?(?:sponsorship|sponsor)|"
    r"sponsorship is not (?:available|offered|provided)|"
    r"no visa sponsorship|without sponsorship|"
    r"must (?:already )?be (?:currently )?(?:legally )?authorized to work[^.]{0,80}without (?:visa )?sponsorship)"
)
VISA_RESIDENT = (
    r"(?i)(green card (?:holders? )?only|green card required|permanent resident(?:s)? only|"
    r"must be a (?:us |u\.s\. )?permanent resident|uscis (?:permanent )?residen|"
    r"us citizen(?:s|ship)? (?:only|required)|must be (a )?(?:us|u\.s\.) citizen|"
    r"(?:u\.s\.|us) citizenship (?:is )?required)"
)
VISA_SPONSOR = (
    r"(?i)(h[- ]?1b (?:visa )?(?:sponsorship )?(?:is )?(?:available|offered|ok|okay|welcome|provided)?"
    r"|visa sponsorship (?:is )?(?:available|offered|provided|welcome)"
    r"|will sponsor (?:h[- ]?1b|visas?|work authorization)"
    r"|sponsorship (?:available|considered|welcome|offered))"
)
VISA_STUDENT = r"(?i)\b((?:stem[- ]?)?opt|cpt|f[- ]?1(?:\s+visa)?|ead)\b"
CLEARANCE = (
    r"(?i)(security clearance|ts/?sci|polygraph|clearance required|"
    r"active (secret|top secret|ts)|must (be|have) (?:a )?(secret|top secret) clearance)"
)
VISA_LABELS = ("No sponsorship", "US citizen / GC only", "H-1B sponsorship", "OPT/CPT mentioned", "Clearance required")
EXPERIENCE = (
    r"(?i)((?:at least |minimum (?:of )?)?\d{1,2}\s*\+?\s*(?:to|-|–)\s*\d{1,2}\s*\+?\s*"
    r"(?:years?|yrs?)(?:\s+of)?(?:\s+[a-z ]{0,20})?experience"
    r"|\d{1,2}\s*\+\s*(?:years?|yrs?)(?:\s+of)?(?:\s+[a-z ]{0,20})?experience"
    r"|(?:entry[- ]level|junior|mid[- ]level|senior)(?:\s+level)?)"
)
SKILLS = (
    "python", "sql", "r", "java", "scala", "pytorch", "tensorflow", "keras", "scikit-learn", "sklearn", "pandas", "numpy", "spark",
    "airflow", "aws", "gcp", "azure", "docker", "kubernetes", "langchain", "transformers", "huggingface", "llm", "nlp", "rag", "mlflow",
    "dbt", "snowflake", "databricks", "tableau", "power bi", "fastapi", "flask", "django", "kafka", "redis", "postgres", "mongodb",
)
STATE = (
    r"\b(AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|"
    r"PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC)\b"
)
REMOTE = r"(?i)\b(remote|work from home|wfh|telecommute)\b"
REMOTE_HINT = r"(?i)\b(remote|work from home|wfh|distributed|anywhere)\b"
STUDENT_TITLE = r"(?i)\b(intern|internship|co-?op|student experience|apprentice)\b"
WEAK_TITLE_WORDS = ("and", "or", "the", "of", "for", "in", "a", "an")
BOARD_SOURCES = (
    "linkedin", "indeed", "glassdoor", "ziprecruiter", "dice", "monster", "simplyhired", "builtin", "wellfound", "handshake", "hired", "otta",
    "remoteok", "weworkremotely", "adzuna", "experteer", "haystack", "appcast", "ycombinator",
)
OFFICIAL_SOURCES = (
    "greenhouse", "lever", "ashby", "workday", "smartrecruiters", "workable", "icims", "taleo", "jobvite", "bamboohr", "breezy", "rippling",
    "eightfold", "successfactors", "jobs2web", "njoyn",
)
SCHEDULING_HOSTS = (
    "calendly.com", "chilipiper.com", "timetrade.com", "appointlet.com", "cal.com", "savvycal.com", "outlook.office.com", "bookingsms",
)

# -- names -----------------------------------------------------------------------
COMPANY_NOISE = (
    "inc", "llc", "ltd", "corp", "corporation", "co", "gmbh", "plc", "pvt", "private", "limited", "technologies", "technology", "solutions",
    "systems", "labs", "group", "team", "careers", "talent", "recruiting", "hr",
)
ROLE_NOISE = (
    "senior", "sr", "junior", "jr", "lead", "principal", "staff", "i", "ii", "iii", "iv", "v", "1", "2", "3", "entry", "level", "remote",
    "hybrid", "onsite", "full", "part", "time", "contract", "intern", "internship",
)

# -- URLs ------------------------------------------------------------------------
#: Hosts (and all below them) of boards, in the order they are tried.
JOB_HOSTS = {
    "linkedin.com": "linkedin",
    "indeed.com": "indeed",
    "glassdoor.com": "glassdoor",
    "ziprecruiter.com": "ziprecruiter",
    "dice.com": "dice",
    "monster.com": "monster",
    "simplyhired.com": "simplyhired",
    "builtin.com": "builtin",
    "wellfound.com": "wellfound",
    "angel.co": "wellfound",
    "joinhandshake.com": "handshake",
    "lever.co": "lever",
    "greenhouse.io": "greenhouse",
    "ashbyhq.com": "ashby",
    "myworkdayjobs.com": "workday",
    "smartrecruiters.com": "smartrecruiters",
    "workable.com": "workable",
    "icims.com": "icims",
    "taleo.net": "taleo",
    "jobvite.com": "jobvite",
    "bamboohr.com": "bamboohr",
    "breezy.hr": "breezy",
    "rippling.com": "rippling",
    "eightfold.ai": "eightfold",
    "successfactors.com": "successfactors",
    "hired.com": "hired",
    "otta.com": "otta",
    "remoteok.com": "remoteok",
    "weworkremotely.com": "weworkremotely",
    "y-combinator.com": "ycombinator",
    "adzuna.com": "adzuna",
    "adzuna.co.uk": "adzuna",
    "experteer.com": "experteer",
    "joinhaystack.com": "haystack",
    "haystack.cv": "haystack",
    "haystackapp.io": "haystack",
    "appcast.io": "appcast",
    "jobs2web.com": "jobs2web",
    "njoyn.com": "njoyn",
    "myworkday.com": "workday",
    "myworkdaysite.com": "workday",
    "jobright.ai": "jobright",
    "jobright.com": "jobright",
    "avature.net": "avature",
    "simplify.jobs": "simplify",
    "ihire.com": "ihire",
    "twine.net": "twine",
    "zoom.us": "zoom",
    "ultipro.com": "ultipro",
    "jobs.apple.com": "apple",
}
#: Parts of hosts that only count clicks.
CLICK_HOSTS = (
    "ct.sendgrid.net", "sendgrid.email", "click.appcast.io", "awstrack.me", "click.mailer.io", "mandrillapp.com", "avature.net",
    "simplify.jobs", "cts.indeed.com", "click.monster.com", "track.ihire.com", "pageuppeople.com", "redirect.twinehq.com",
    "api.clinchtalent.com", "ukgjobalerts.com", "daliajobs.com", "arc.dev",
)
#: Parameters that carry a wrapped destination, and that name a posting, in order.
WRAPPERS = ("url", "u", "redirect", "redirect_url", "target", "destination", "link", "r", "q")
ID_PARAMETERS = ("jk", "gh_jid", "jobid", "jobId", "jobListingId", "currentJobId", "requisitionid", "vjk", "guid", "j", "opportunityId")
WEAK_ID_PARAMETERS = ("id",)
POSTING_PATH = (
    r"(?i)/(jobs?/view|viewjob|job-listing|job-detail|jobs?/\d+|rc/clk|pagead/clk|"
    r"jobs?/[a-z0-9-]+/[0-9a-f-]{8,}|careers?/job|job/|opportunit|job_app|"
    r"partner/joblisting|remote-jobs?/[a-z0-9][a-z0-9-]{3,}|go$)"
)
STRONG_POSTING_PATH = (
    r"(?i)/(jobs?/view/|viewjob|job-listing|job-detail|job_app|"
    r"(jobs?|careers?|positions?|openings?|vacanc(y|ies))/[^/]*\d{3,}|"
    r"(jobs?|careers?|positions?|openings?)/[a-z0-9-]+/[0-9a-f-]{8,}|"
    r"job/[^/]+/\d[\w.-]*)"
)
TITLED_PATH = r"(?i)/job/[^/]+/[^/]+"
UUID_PATH = r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
SEARCH_PATH = (
    r"(?i)/(jobs/search|q-|browse|alerts?|my-alerts|unsubscribe|settings|help|feed|privacy|"
    r"interview/index|community/bowl|profile/job-preferences)"
)
AWAY_PATH = r"(?i)/(unsubscribe|settings|privacy|help|interview/index|community/bowl|editagent)"

# -- digests: lines of cards and labels of links ---------------------------------
FOOTER_TEXT = (
    r"(?i)^(unsubscribe|privacy policy|view all jobs|see more jobs|view relevant jobs|"
    r"update your preferences|"
    r"update your profile|browse all|post a job|get more recommendations|we want to know|"
    r"adjust your job alert notifications?|this is a bad match)$"
)
FOOTER_PARTS = (
    "unsubscribe", "privacy.htm", "update your preferences", "view all jobs", "view relevant jobs", "/interview/index", "community/bowl",
    "job-preferences",
)
LOCATION_HINT = (
    r"(?i)(remote|hybrid|on-?site|,\s*[A-Z]{2}\b|United States|USA|India|Canada|Europe|"
    r"New York|San Francisco|Seattle|Austin|Boston|Chicago|Dallas|Atlanta|Denver)"
)
NOISE_LINE = (
    r"(?i)^(view job|apply now(?:\s*→)?|see all|actively hiring|easy apply|be an early applicant|"
    r"\d+\s+(school|connection|alum)|promoted|new|technology|full[- ]time|part[- ]time|"
    r"(?:just now|\d+\s+(?:hour|day|week|minute)s? ago)\b.*|"
    r"posted|save|unsubscribe|view all jobs|browse all jobs|"
    r"top match|more details.*|this job is available in multiple locations)$"
)
TITLE_HINT = (
    r"(?i)\b(engineer|scientist|developer|analyst|specialist|architect|researcher|"
    r"consultant|intern|co-?op|coordinator|associate|director|manager|lead|"
    r"principal|staff|accountant|strategist|machine learning|software|research|"
    r"data science|ai/?ml|nlp|llm)\b"
)
TITLE_ROLE = (
    r"(?i)\b(engineer|scientist|developer|analyst|specialist|architect|researcher|"
    r"consultant|intern|co-?op|coordinator|associate|director|manager|lead|"
    r"principal|staff|accountant|strategist)\b"
)
COMPANY_HINT = (
    r"(?i)\b(inc\.?|llc|ltd\.?|corp\.?|co\.|company|group|university|college|"
    r"laboratories|hospital|partners|holdings|technologies)\b"
)
PAY_LINE = (
    r"(?i)(\$\s?\d|\bUSD\b|\bEUR\b|\bGBP\b|\bCAD\b|"
    r"\d[\d,]+\s*[-–]\s*\d|"
    r"\d+\s*[-–]\s*\d+\s*(k|/yr|/hr|an hour|per year)|"
    r"\d[\d,]+\s+a year)"
)
JUNK_TITLE = (
    r"(?i)(search for more|see the latest|see more jobs?|show me more|view all|browse all|update your|"
    r"unsubscribe|manage settings|privacy policy|^jobs for |^create$|"
    r"^job alert:|.+ jobs$|has not been updated|minimum base pay|job listings|"
    r"improve your alerts|telling us what you.re looking for|"
    r"email preferences|^preferences$|^\d{4}\s+\S+,?\s+inc|"
    r"gift \d+ free|^share now$|^learn why|^help$|^terms and|^conditions:|"
    r"^edit$|job matches for)"
)
APPLY_CALL = (
    r"(?i)^(apply now|apply\b|view job|see job|view (all )?opportunit(y|ies)|learn more|read more|"
    r"(?:1|one)[\s-]?click apply|quick apply|easy apply)\b"
)
ADDRESS_LINE = (
    r"(?i)^\d+\s+\w|"
    r"\b(blvd|boulevard|street|st\.|ave|avenue|road|rd\.|suite|ste\.|floor|fl\.|"
    r"drive|dr\.|lane|ln\.|way|parkway|pkwy|plaza|hwy|highway)\b"
)

# -- pages -----------------------------------------------------------------------
#: Elements that are no part of a page's body; class names of those that may be it.
CHROME = ("script", "style", "nav", "footer", "header", "form", "aside", "noscript")
BODY_CLASS = r"(?i)(job|description|posting|details|content)"
FORM_PAGE = r"(?i)(indicates a required field|attach.{0,20}dropbox|accepted file types|enter manually|autofill my application)"
BLOCKED_PAGE = (
    r"(?i)(captcha|unusual traffic|are you a human|access denied|request blocked|"
    r"enable javascript to|cloudflare|please verify you are|sign in to continue|"
    r"401 unauthorized|403 forbidden|sign in with (apple|a passkey|google)|"
    r"new to linkedin|join now|get hired without the hassle|"
    r"your activity and behavior on this site made us think that you are a bot|"
    r"radware captcha)"
)
STOPOVER_PAGE = (
    r"(?i)(you are now being redirected|if you are not redirected within|"
    r"this website uses (only essential )?cookies|"
    r"by continuing to browse this website|"
    r'"widget"\s*:\s*"redirect")'
)
MENU_PAGE = r"(?is)skip to (?:main )?content.{0,400}(language|čeština|deutsch \(|select language)"
POSTING_WORDS = r"(?i)\b(responsibilities|requirements|qualifications|what you.ll do)\b"
SHELL_TITLE = (
    r"(?i)(get hired without the hassle|^haystack\b|sign in to (continue|linkedin)|"
    r"page not found|access denied|adzuna jobs search|^adzuna$|"
    r"radware captcha|cookie (policy|consent|settings))"
)
#: Characters of a page by which it is judged, and of which a body has at least so many.
BLOCKED_WITHIN, BLOCKED_MOST, BODY_LEAST, FORM_WITHIN, STOPOVER_WITHIN, MENU_WITHIN = 2000, 1500, 200, 1500, 4000, 1200
#: Where boards give a posting as JSON: board, pattern of ``key url``, address, name of the parser.
API_TARGETS = (
    (r"^linkedin:(\S+) ", "https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/$1", "linkedin"),
    (r"^greenhouse:(\S+) \S*[?&]for=([A-Za-z0-9_-]+)", "https://boards-api.greenhouse.io/v1/boards/$2/jobs/$1", "greenhouse"),
    (r"^greenhouse:(\S+) \S*greenhouse\.io/(?:embed/)?([A-Za-z0-9_-]+)/jobs", "https://boards-api.greenhouse.io/v1/boards/$2/jobs/$1", "greenhouse"),
    (r"^lever:([^:\s]+):(\S+) ", "https://api.lever.co/v0/postings/$1/$2?mode=json", "lever"),
    (r"^ashby:([^:\s]+):\S+ ", "https://api.ashbyhq.com/posting-api/job-board/$1?includeCompensation=true", "ashby"),
    (
        r"^\S* https?://(([^./\s]+)\.[^/\s]*myworkday(?:jobs)?\.com[^/\s]*)/(?:[^\s?#]*/)?(?!(?:wday|cxs)/)([^/\s]+)/job/([^\s?#]+?)/*(?:[?#]\S*)?$",
        "https://$1/wday/cxs/$2/$3/job/$4", "workday",
    ),
    (r"^\S* https?://[^/\s]*smartrecruiters\.com/([^/\s?#]+)/(?:[^\s?#]*/)?([^/\s?#]+)/*(?:[?#]\S*)?$", "https://api.smartrecruiters.com/v1/companies/$1/postings/$2", "smartrecruiters"),
    (r"(?i)^\S* \S*apply\.workable\.com/([^/\s]+)/j/([^/\s?#]+)", "https://apply.workable.com/api/v2/accounts/$1/jobs/$2", "workable"),
    (r"^indeed:(\S+) ", "https://www.indeed.com/viewjob?jk=$1", "html"),
)
