"""Word lists and patterns that results depend on. All are defaults: every function that uses one takes it as a parameter."""

from __future__ import annotations

# Words that carry no meaning in job titles.
STOPWORDS = ("a", "an", "and", "engineer", "for", "in", "of", "or", "the", "to")

# Glyphs that begin list items.
BULLETS = "•●▪◦■*-–—§"

# Spelling of a skill, and its canonical name.
SKILLS = {
    "ajax": "AJAX", "aws": "AWS", "azure": "Azure", "c#": "C#", "c++": "C++", "c": "C", "css": "CSS", "data analysis": "Data Analysis",
    "data structures": "Data Structures", "django": "Django", "docker": "Docker", "eclipse": "Eclipse", "faiss": "FAISS", "fastapi": "FastAPI",
    "flask": "Flask", "git": "Git", "hadoop": "Hadoop", "html": "HTML", "information retrieval": "Information Retrieval", "java ee": "Java EE",
    "java": "Java", "javascript": "JavaScript", "kubernetes": "Kubernetes", "latex": "LaTeX", "linux": "Linux", "machine learning": "Machine Learning",
    "mapreduce": "MapReduce", "matlab": "MATLAB", "mongodb": "MongoDB", "mysql": "MySQL", "netbeans": "NetBeans", "nlp": "NLP", "node.js": "Node.js",
    "nodejs": "Node.js", "numpy": "NumPy", "opencv": "OpenCV", "pandas": "Pandas", "php": "PHP", "postgresql": "PostgreSQL", "postgres": "PostgreSQL",
    "probability and statistics": "Probability and Statistics", "python": "Python", "pytorch": "PyTorch", "react": "React", "redis": "Redis",
    "scikit-learn": "scikit-learn", "spark": "Spark", "spacy": "spaCy", "spring": "Spring", "sql": "SQL", "tableau": "Tableau", "tensorflow": "TensorFlow",
    "verilog": "Verilog", "web services": "Web Services", "windows": "Windows", "xml": "XML",
}
# Acronyms beyond the skills, and phrases that head a list of skills without being one.
ACRONYMS = ("API",)
SKILL_HEADS = ("programming languages", "software", "operating systems", "web designing languages")

# Headings of the sections of a résumé; sections are tried in this order.
SECTIONS = {
    "education": ("education", "academic profile", "academeic profile", "academic background", "academic qualification", "academic qualifications", "educational qualification", "qualification", "qualifications", "academic history", "education background", "studies"),
    "skills": ("skills", "technical", "technical skills", "skill set", "core competencies", "tools technologies", "tools and technologies", "software proficiency", "relevant courses taken", "expertise", "skills languages", "technical proficiencies"),
    "experience": ("experience", "work experience", "professional experience", "employment history", "work experience internship", "internship", "internships", "work history", "professional background", "career history", "relevant experience", "employment"),
    "projects": ("projects", "academic projects", "project experience", "research projects", "key projects", "selected projects", "personal projects", "technical projects", "contributions", "open source", "featured projects"),
    "certifications": ("qualification certificates", "certification", "certifications", "licenses", "licenses certifications", "courses certifications"),
    "achievements": ("achievements", "academic achievements", "awards", "honors", "scholarships", "academic distinctions", "position of responsibility", "positions of responsibility", "extra curricular achievements", "extra curriculars", "extra curricular activities", "extracurricular achievements", "extracurriculars", "extracurricular activities"),
}
LONGEST_HEADING = 40

# Headings of a job description and the part each opens, and its labelled lines.
JOB_SECTIONS = {"about the role": "about", "key responsibilities": "responsibilities", "required skills": "required_skills", "preferred skills": "preferred_skills", "education": "education", "good fit indicators": "good_fit_indicators"}
JOB_LABELS = {"Job Title:": "job_title", "Location:": "location", "Employment Type:": "employment_type", "Experience Required:": "experience_required"}

# Patterns of contacts and dates.
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"\+?\d[\d ()-]{8,}\d"
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*[’']?"
YEAR_SPAN = r"\b(?:19|20)\d{2}(?:\s*(?:-|to|–)\s*(?:present|current|(?:19|20)\d{2}))?\b"
DATE_RANGE = rf"(?:{MONTH}\s*\d{{2,4}}\s*(?:-|–|to)\s*(?:present|current|{MONTH}\s*\d{{2,4}})|(?:19|20)\d{{2}}\s*(?:-|–|to)\s*(?:present|current|(?:19|20)\d{{2}}))"
BRACKETED_RANGE = r"\([^)]*(?:19|20)\d{2}[^)]*\)"
SCORE = r"(?:CGPA|GPA|Marks Obtained|Score|Percentage|Percentile)\s*[:\-]?\s*[\d.]+(?:/\d+)?%?|\b\d+(?:\.\d+)?/\d+\b|\b\d+(?:\.\d+)?\s*%"
DEGREE = r"\b(?:dual degree|b\.?\s?tech|m\.?\s?tech|b\.?\s?e\.?|m\.?\s?e\.?|bachelor|master|mba|mca|bca|b\.?\s?sc|m\.?\s?sc|ph\.?d|doctorate|diploma|class xii|class x|senior secondary|secondary|cbse|hsc|ssc)\b"
INSTITUTION = (
    r"(?:IIT|IIIT|NIT)\s+[A-Z][A-Za-z]+|[A-Z][A-Za-z.&'/-]*(?:\s+[A-Z][A-Za-z.&'/-]*){0,8}\s+"
    r"(?:University|Institute(?:\s+of\s+Technology)?|College|School|Academy|Polytechnic)(?:,?\s*[A-Z][A-Za-z.&'/-]+){0,3}"
)
EDUCATION_START = r"(?:(?:19|20)\d{2}(?:\s*[-/]\s*(?:present|current|(?:19|20)\d{2}))?|dual degree|class\s+[xiv]+|b\.?\s*tech|m\.?\s*tech|bachelor|master|senior secondary|secondary|cbse)"
EDUCATION_HEADERS = ("year", "degree certificate", "degree board", "institute school", "board university", "marks obtained", "completion", "cgpa", "examination")
EDUCATION_HEADER_WORDS = ("year", "college", "school", "board", "cgpa", "degree", "marks", "completion")
NOT_NAMES = ("resume", "curriculum vitae", "academic profile", "academeic profile", "education", "skills", "email", "phone", "mobile", "address", "roll no", "dob")

# Words of file names that say nothing about a person.
FILE_WORDS = ("bio", "biodata", "candidate", "copy", "curriculum", "cv", "data", "draft", "example", "final", "latest", "new", "profile", "resume", "resumes", "rev", "revised", "revision", "update", "updated", "ver", "version", "vitae")
TEMPLATE_WORDS = ("example", "sample", "template")
MONTHS = ("jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august", "sep", "sept", "september", "oct", "october", "nov", "november", "dec", "december")
FILE_MARKERS = (r"\(\s*\d+\s*\)", r"\[\s*\d+\s*\]", r"\bcopy\b", r"\bfinal\b", r"\bupdated?\b", r"\bnew\b", r"\blatest\b", r"\bdraft\b", r"\brevised?\b", r"\brev(?:ision)?\b", r"\bv(?:er(?:sion)?)?\s*[_-]?\s*\d+\b")

# Weights of the five signals of a candidate.
WEIGHTS = {"semantic_similarity": 0.45, "skill_coverage": 0.25, "experience_alignment": 0.15, "education_match": 0.10, "role_relevance": 0.05}
# Spellings of the splits of a label set.
SPLITS = {"train": "train", "training": "train", "val": "validation", "valid": "validation", "validation": "validation", "test": "test"}
# Files that may be read, uploaded and audited.
RESUME_SUFFIXES = (".pdf", ".docx", ".txt")
AUDIT_SUFFIXES = (".pdf", ".doc", ".docx", ".txt")
