"""Results depend on these exact words, patterns and constants."""

# English stop words.
ENGLISH_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does",
    "did", "will", "would", "should", "can", "could", "may", "might", "shall", "not", "no",
    "it", "its", "this", "that", "these", "those", "i", "you", "he", "she", "we", "they", "me",
    "him", "her", "us", "them", "my", "your", "his", "our", "their", "what", "which", "who",
    "whom", "where", "when", "why", "how", "all", "each", "every", "both", "few", "more",
    "most", "other", "some", "such", "than", "too", "very", "just", "about", "above", "after",
    "again", "also", "any", "because", "before", "between", "into", "through", "during", "out",
    "off", "over", "under",
]

# Korean stop words.
KOREAN_STOP_WORDS = [
    "이", "가", "을", "를", "에", "의", "와", "과", "으로", "로", "에서", "은", "는", "도", "만", "까지", "부터",
    "에게", "께", "한테", "더", "그", "저", "그것", "이것", "저것", "그런", "이런", "저런", "및", "등", "것", "수",
    "위해", "대한", "통해", "따라", "하는", "있는", "되는", "하여", "하고", "있으며", "합니다", "그리고", "하지만", "그러나",
    "또는", "또한", "때문에",
]

STOP_WORDS = ENGLISH_STOP_WORDS + KOREAN_STOP_WORDS

# Fixed value: token pattern, applied to lower-cased text.
TOKEN_PATTERN = r"[가-힣]+|[a-zA-Z]+(?:\p{Nd}+[a-zA-Z]*)*|\p{Nd}+[a-zA-Z]+"

# Search-intent patterns, matched anywhere without case.
SEARCH_INTENT_PATTERNS = [
    "프로젝트.*찾아", "프로젝트.*추천", "프로젝트.*검색", "프로젝트.*알려", "프로젝트.*있[어을나]", "사례.*찾아", "사례.*추천",
    "사례.*검색", "사례.*알려", "사례.*있[어을나]", "유사.*프로젝트", "유사.*사례", "비슷한.*프로젝트", "비슷한.*사례", "시스템.*구축",
    "시스템.*개발", "시스템.*도입", "솔루션.*구축", "솔루션.*도입", "플랫폼.*구축", "플랫폼.*개발", "관련.*프로젝트", "관련.*사례",
    "업무.*사례", "업종.*사례", "구축.*사례", "개발.*사례", "도입.*사례", "어떤.*프로젝트", "어떤.*사례", "찾아줘", "추천해줘",
    "추천.*해줘", "검색.*해줘", "ERP", "SCM", "CRM", "MES", "WMS", "HR", "고도화", "차세대",
]

# Patterns asking to apply an attached file.
FILE_INTENT_PATTERNS = [
    "반영", "적용", "업데이트", "처리", "실행", "진행", "파일.*반영", "파일.*적용", "파일.*업데이트", "파일.*처리", "첨부.*반영",
    "첨부.*적용", "첨부.*업데이트", "첨부.*처리", "프로젝트.*현황.*반영", "프로젝트.*현황.*적용",
]

# Texts and numbers that appear in results.
SUMMARY_PREFIX = "프로젝트 배경 및 요약: "
NO_RESULT_MESSAGE = "검색 조건과 일치하는 프로젝트가 없습니다. 다른 키워드로 다시 검색해보세요."
NOT_FOUND_MESSAGE = "ID '{}'에 해당하는 프로젝트를 찾을 수 없습니다."
DONE_PREFIX = "처리 완료: "
COUNT_LABELS = {
    "inserted": "신규 등록",
    "updated": "업데이트",
    "skipped": "변경없음",
    "error": "오류",
}
COUNT_UNIT = "개"
UNKNOWN_TOOL = "알 수 없는 도구: "
CONTEXT_PREFIX = "참고 정보:\n"
EMBEDDING_SIZE = 1024
MAX_RESULTS = 10
DEFAULT_RESULTS = 5

# Tools and the arguments they take.
TOOL_ARGUMENTS = {
    "recommend_projects": ["query", "max_results"],
    "update_projects_from_excel": ["file_path"],
}

# Cell texts read as "no value".
NULL_TEXTS = ["", "None", "nan", "NaT"]
BLANK_KEY_TEXTS = ["", "None", "nan"]

# Legal values of the two constrained record columns.
PHASES = [
    "Pre-Con Deployment Approval",
    "Contract Approval Request",
    "Execution Plan Approval",
]
BUSINESS_TYPES = ["유지보수", "신규", "지원"]
GRADES = ["A", "B", "C"]
