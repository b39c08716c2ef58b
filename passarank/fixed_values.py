"""Values that must stay as they are for results to be right: settings, word lists, prompt texts."""

# Ranking settings.
HITS_PER_QUERY = 256
DEFAULT_HITS = 10  # the vector store's own default, used when no number of hits is asked for
ENTITIES_RETURNED = 8
EXAMPLES_PER_QUERY = 4
DEFAULT_THRESHOLD = 0.5
CALLERS_THRESHOLD = 0.6
TOPIC_WEIGHT = 0.65
EVALUATION_WEIGHT = 0.35
RESULTS_DISPLAYED = 5
SYLLABUS_ROWS = 16

# Keys of a split request.
TOPIC_KEY = "주제관련"
EVALUATION_KEY = "평가관련"

# Labels of the two ordinal scales.
GRADE_SCALE = {"기대 이상": 5, "보통": 3, "기대 이하": 1}
ATTENDANCE_SCALE = {"매번함": 5, "자주함": 4, "종종함": 3, "거의안함": 2, "아예안함": 1}

# Cell positions of a course row (cell 0 is not used).
COURSE_CELLS = {
    "course_no": 1,
    "course_class": 2,
    "course_type": 3,
    "department": 4,
    "course_name": 5,
    "instructor": 6,
    "credit": 7,
    "room": 8,
}

# Patterns and texts used when passages are made.
ALLOWED_CHARACTERS = "ㄱ-ㅎㅏ-ㅣ가-힣a-zA-Z0-9"
TITLE_SUFFIX = "을 가르치는 수업"
ATTACHMENT_MARKER = "▶ 첨부파일"
REVIEW_RULE = "\n___\n"

# Delimiters in raw model output.
INSTRUCTION_END = "[/INST]"
END_OF_TEXT = "</s>"

# Prompt that splits a request, its worked examples and its system message.
SPLIT_SYSTEM_MESSAGE = (
    "너는 문장을 '수업의 강의 주제과 관련된 문장', '수업의 평가와 관련된 문장'으로 분류하는 문장 분류 전문가야."
)
SPLIT_TEMPLATE = """
    예시:

    질문:
    {example_query}

    답변:
    {example_answer}

    위의 형식과 동일한 형식으로 다음 질문에 대한 답변해주세요.

    질문:
    {query}

    답변:
    """
SPLIT_EXAMPLE_ANSWER = (
    '{"주제관련": ["인공지능과 관련된 수업", "수업 안에서 인공지능의 원론적인 내용보다는 딥러닝 관련 내용을 배우는 수업"],'
    '    "평가관련": ["빡세더라도 얻어가는게 많은 수업", "교수님이 학점을 잘주시는 수업", "교수님이 강의력이 좋은 수업"]}'
)
SPLIT_EXAMPLE_QUERIES = {
    "local": (
        "나는 인공지능과 관련된 수업을 듣고 싶어. 또, 수업 안에서 인공지능의 원론적인 내용보다는 딥러닝 관련 내용을 배우고싶어. "
        "빡세더라도 얻어가는게 많았으면 좋겠어. 그리고 교수님이 학점을 잘 주시고 강의력이 좋으면 좋겠어."
    ),
    "hosted": (
        "나는 인공지능과 관련된 수업을 듣고 싶은데, 빡세더라도 얻어가는게 많았으면 좋겠어. "
        "수업 안에서 인공지능의 원론적인 내용보다는 딥러닝 관련 내용을 배우고싶고 교수님이 학점을 잘 주시고 강의력이 좋으면 좋겠어."
    ),
}

# Prompt that answers with evidence, and the input of the summary turn.
ANSWER_TEMPLATE = """너는 수업 개요와 강의평이 주어지면 사용자의 요구사항에 맞게 질문에 답해주는 대화형 AI야.
        중요한 것은 주어진 대화내용과 수업 개요, 강의평만을 이용해서 답해야 한다는 것이고 주어진 수업 정보로 알 수 없는 내용을 물어본다면 솔직하게 모른다고 답해야해.

        수업 개요: {info}

        강의평: {review}

        대화 내용: {history}

        요구사항: {input}

        답변:
        """
SUMMARY_TEMPLATE = """조건: {query}
        수업 개요와 강의평을 요약해서 이 강의가 조건에 적합한 강의인지 알려주세요.
        조건에 대한 내용만 포함해서 요약하는 것이 중요합니다.
        """
HISTORY_TURN = "\n\nHuman: {input}\nAI: {answer}"
