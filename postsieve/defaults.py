"""Template configuration: the values a new installation starts from.

Every operator takes its lexicon, blocklist, roster and threshold as arguments;
passing a value replaces the template value as a whole.
"""

MIN_SCORE = 5

# Must equal the published template for equal results.
TITLE_BLOCKLIST = [
    "cloud infrastructure",
    "infrastructure engineer",
    "devops",
    "dev ops",
    "site reliability",
    "sre engineer",
    "data scientist",
    "data engineer",
    "mobile engineer",
    "android engineer",
    "ios engineer",
    "security engineer",
    "cybersecurity",
    "network engineer",
    "network administrator",
    "database administrator",
    "dba ",
    "blockchain",
    "crypto engineer",
    "web developer",
    "ui engineer",
    "ux engineer",
    "growth engineer",
    "platform engineer",
    "solutions architect",
    "cloud architect",
    "senior cloud",
    "vp of engineering",
    "director of engineering",
    "chief technology",
    "cto",
    "hr coordinator",
    "recruiter",
    "talent acquisition",
    "financial analyst",
    "accountant",
    "marketing manager",
    "content creator",
    "social media",
    "sales representative",
    "account executive",
    "business development",
    "legal counsel",
    "attorney",
    "paralegal",
]

# Must equal the published template for equal results.
KEYWORD_WEIGHTS = {
    "audio engineer": 8,
    "audio software engineer": 10,
    "audio software": 10,
    "audio plugin": 10,
    "plugin developer": 9,
    "sound designer": 8,
    "spatial audio": 9,
    "immersive audio": 8,
    "audio middleware": 8,
    "audio dsp": 10,
    "dsp engineer": 10,
    "real-time audio": 9,
    "audio signal processing": 9,
    "signal processing engineer": 9,
    "juce": 9,
    "embedded audio": 8,
    "audio machine learning": 9,
    "audio ai": 8,
    "ml audio": 9,
    "audio qa": 9,
    "audio quality engineer": 9,
    "audio test engineer": 8,
    "perceptual evaluation": 9,
    "bioacoustics": 10,
    "passive acoustic monitoring": 10,
    "acoustic monitoring": 8,
    "soundscape ecology": 10,
    "wildlife acoustics": 9,
    "field recording": 7,
    "mycology": 10,
    "mycologist": 10,
    "fungal biology": 9,
}

# Must equal the published template for equal results.
ROSTER = [
    ("iZotope", "greenhouse", "izotope"),
    ("Avid Technology", "greenhouse", "avid"),
    ("Dolby", "greenhouse", "dolby"),
    ("Native Instruments", "greenhouse", "nativeinstruments"),
    ("Ableton", "lever", "ableton"),
    ("Shure", "lever", "shure"),
    ("ElevenLabs", "ashby", "elevenlabs"),
    ("Deepgram", "ashby", "deepgram"),
]

# Score floor of each tier, its label and its colour. Scores below
# the last floor take the label and colour of BASE_TIER.
TIERS = [
    (20, "Excellent Match", 0x00FF00),
    (10, "Strong Match", 0xFFA500),
    (5, "Good Match", 0x3498DB),
]
BASE_TIER = ("Target Company", 0x95A5A6)

# Run-summary colours without and with errors.
SUMMARY_OK_COLOUR = 0x00FF00
SUMMARY_ERROR_COLOUR = 0xFF6B35
