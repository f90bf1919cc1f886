"""Prompt wording, conversation templates and judge texts.

Results depend on these texts word for word. ``{destination}`` is filled per image.
"""

TARGETS = ["D", "L", "R", "P", "Desc"]
DECISION = "Decs"

SYSTEM_BASE = (
    "A chat between a human and an AI that understands visuals in English. "
    "In images, [x, y] denotes points: top-left [0.0, 0.0], bottom-right [1.0, 1.0]. "
    "Increasing x moves right; y moves down. Decreasing x moves left; y moves up. Bounding box: [x1, y1, x2, y2]. "
    "Image size: 1.0x1.0."
    "The input image depicts the view from a pedestrian's position, taken at a point 80cm above the ground for pedestrian navigation purposes. "
    "The user is looking at the center [0.5, 0.5] of the image. "
    "Consider the starting point as the ground where the user is standing. "
    "Explain as if you were a navigation assistant explaining to a visually impaired person. "
    "Rules: \n"
    "1. Do not talk about detailed image coordinates. Never use pixel positional information. "
    "2. Consider perspective view of the 2D image property. "
)
DECISION_RULES = (
    "3. If the user is in front of a crosswalk, look for the pedestrian traffic light and tell me the color of the light. If there is a red pedestrian traffic light, say 'Stop and wait' option. "
    "4. If there is an obstacle in the path obstructing the user's walk, say 'Stop and wait' option. "
    "5. If the path leads the user into dangerous areas like roads or construction sites, say 'Stop and wait' option. "
    "6. If the path is clear of obstacles, say 'Follow the path' option. "
)
BOXES_LEAD = "The image contains objects, "

_GOAL_POINT = "Assume the orange {destination} in the visible area is the user's destination. "
_GOAL_NAMED = "Assume the user's destination is the {destination} in the image. "
_PATH_VIEW = "Assume the visible area in the image is the user's path and the user moves forward along the visible area of the image. "
_LEFT_VIEW = "Assume the visible area in the image is to the left of the user's path. "
_RIGHT_VIEW = "Assume the visible area in the image is to the right of the user's path. "
_WIDE_PATH = "Assume the user is moving along a 2-meter-wide path from the starting point [0.5, 1.0] to the destination {destination} in the image. "
_GOAL_POINT_ASK = (
    "Analyze the area and provide a one-sentence description of the destination. "
    "Do not talk about orange point to represent the destination. "
)
_GOAL_ASK = "Provide a one-sentence description of the destination where the user's path is heading. "
_GOAL_EXAMPLES = (
    "Example 1) The destination is ahead on the sidewalk. "
    "Example 2) The destination is ahead on the car road. "
    "Example 3) The destination is ahead but is obscured by a truck. "
    "Example 4) The destination is ahead at the entrance of the building. "
)
_VIEW, _INPUT = "Analyze the visible area", "Analyze the input image"
_LEFT_ASK = (
    " and provide a one-sentence description that includes what is located closely to the left of the path. "
    "If there are no special objects other than the floor, say 'nothing'. "
    "Example 1) There are cars on the left side. "
    "Example 2) There are nothing than the floor on the left side. "
)
_RIGHT_ASK = (
    " and provide a one-sentence description that includes what is located closely to the right of the path. "
    "If there are no special objects other than the floor, say 'nothing'. "
    "Example 1) There are people on the right side. "
    "Example 2) There are nothing than the floor on the right side. "
)
_PATH_ASK = (
    " and provide a one-sentence description of what objects are on the path. "
    "Example 1) There are cars and people on the path. "
    "Example 2) There are nothing on the path. "
)
_SCENE_ASK = (
    "Describe where the user is located based on the image. "
    "If the user is in front of a crosswalk, look for the pedestrian traffic light and tell me the color of the light. "
    "Example 1) The user is in front of a crosswalk. The pedestrian traffic light is red. "
    "Example 2) The user is in front of a construction site. "
)
_DECIDE_ASK = (
    "Based on the current description, evaluate the user is able to move along the path without collision or collide with other objects. "
    "Then, select the most appropriate action: 'Follow the path' or 'Stop and wait'. "
    "Say only the answer, explaining the selection and the reason in two sentences. "
)
_DECIDE_EXAMPLES = [
    "Example 1) Stop and wait. A car is on the path, so walking to the destination is impossible. ",
    "Example 2) Follow the path. The path is clear of obstacles, so walking to the destination is possible. ",
    "Example 3) Stop and wait. It is in front of the crosswalk and the pedestrian traffic light is red, so walking to the destination is impossible. ",
]
_DECIDE = " ".join([_DECIDE_ASK, *_DECIDE_EXAMPLES])

PROMPT_LIBRARIES = {
    # one masked view per region, goal drawn as a point
    "region_views": {
        "D": _GOAL_POINT + _GOAL_POINT_ASK + _GOAL_EXAMPLES,
        "L": _LEFT_VIEW + _VIEW + _LEFT_ASK,
        "R": _RIGHT_VIEW + _VIEW + _RIGHT_ASK,
        "P": _PATH_VIEW + _VIEW + _PATH_ASK,
        "Desc": _SCENE_ASK,
        "Decs": _DECIDE,
    },
    # masked views, the goal seen through the path view
    "path_view": {
        "D": _PATH_VIEW + _GOAL_ASK + _GOAL_EXAMPLES,
        "L": _LEFT_VIEW + _VIEW + _LEFT_ASK,
        "R": _RIGHT_VIEW + _VIEW + _RIGHT_ASK,
        "P": _PATH_VIEW + _VIEW + _PATH_ASK,
        "Desc": _SCENE_ASK,
        "Decs": _DECIDE,
    },
    # masked views, the goal named in the whole image
    "whole_goal": {
        "D": _GOAL_NAMED + _GOAL_ASK + _GOAL_EXAMPLES,
        "L": _LEFT_VIEW + _VIEW + _LEFT_ASK,
        "R": _RIGHT_VIEW + _VIEW + _RIGHT_ASK,
        "P": _PATH_VIEW + _VIEW + _PATH_ASK,
        "Desc": _SCENE_ASK,
        "Decs": _DECIDE,
    },
    # the whole image for every question
    "whole_image": {
        "D": _GOAL_NAMED + _GOAL_ASK + _GOAL_EXAMPLES,
        "L": _WIDE_PATH + _INPUT + _LEFT_ASK,
        "R": _WIDE_PATH + _INPUT + _RIGHT_ASK,
        "P": _WIDE_PATH + _INPUT + _PATH_ASK,
        "Desc": _SCENE_ASK,
        "Decs": _DECIDE,
    },
}

SINGLE_TURN_PROMPT = " ".join(
    [
        _WIDE_PATH + "Provide the response in a structured format with numbered sections to separate the details clearly: \n",
        "1. Destination Description: \n" + _GOAL_ASK + _GOAL_EXAMPLES + "\n",
        "2. Left Side of the Path: \n" + _INPUT + _LEFT_ASK + "\n",
        "3. Right Side of the Path: \n" + _INPUT + _RIGHT_ASK + "\n",
        "4. Path Description: \n" + _INPUT + _PATH_ASK + "\n",
        "5. Overall Scene and Pedestrian Traffic Light: \n" + _SCENE_ASK + "\n",
        "6. Walkability Evaluation: \n" + _DECIDE_ASK + "".join(_DECIDE_EXAMPLES) + "\n",
    ]
)

DECISION_LEAD = "The image description is following: "
DECISION_TAIL = " Say only the answers. "
SUMMARY_SYSTEM = "A chat between a human and an AI that understands visuals in English. "
SUMMARY_COMMAND = (
    "Summarize the following sentences into one sentence. "
    "The summarized sentence should include what is at the destination, on the left, on the right, and on the path, the recommended action, and its reason. "
    "Answer with the summarized content only. "
)
SUMMARY_LEAD = " This is sentences: "

JUDGE_SYSTEM = (
    "Please act as an impartial judge and evaluate the quality of the description provided by an "
    "AI assistant to the user. Your evaluation should consider correctness and "
    "helpfulness. You will be given a reference description and the assistant's description. You "
    "evaluation should focus on the assistant's description. Begin your "
    "evaluation by comparing the assistant's description with the reference description. Identify and "
    "correct any mistakes. Be as objective as possible. After providing your explanation, you "
    "must rate the response on a scale of 1 to 10 by strictly following this format: "
    '"[[rating]]", for example: "Rating: [[5]]". \n'
)
JUDGE_SYSTEM_CONCISE = (
    "Please act as an impartial judge and evaluate the quality of the description provided by an "
    "AI assistant to the user. Your evaluation should consider correctness, "
    "helpfulness, and conciseness. You will be given a reference description and the assistant's description. You "
    "evaluation should focus on the assistant's description. Begin your "
    "evaluation by comparing the assistant's description with the reference description. Identify and "
    "correct any mistakes. Evaluate the conciseness of the assistant's description. Be as objective as possible. "
    "After providing your explanation, you "
    "must rate the response on a scale of 1 to 10 by strictly following this format: "
    '"[[rating]]", for example: "Rating: [[5]]". \n'
)
JUDGE_REFERENCE = ("<|The Start of Reference Description|>\n", "\n<|The End of Reference Description|>\n\n")
JUDGE_ANSWER = ("<|The Start of Assistant A's Description|>\n", "\n<|The End of Assistant A's Description|>\n")

KEYWORD_LEAD = "Description: "
KEYWORD_QUESTIONS = {
    "recommend": '\nAccording to the following sentence, can the user walk? Should the user stop? Choose between "walk" and "stop".  Say only a word. ',
    "destination": "\nAccording to the description, where is the destination? Say only words. If it is obscured or covered, say the objects instead of the destination. ",
    "other": "\nAccording to the description, what objects are on the {target} other than the floor? Say only words. ",
}

# Ground-truth field, record field, name used in questions.
EVALUATED_FIELDS = [
    ("dest", "dest_desc", "destination"),
    ("left", "left_desc", "left"),
    ("right", "right_desc", "right"),
    ("path", "path_desc", "path"),
    ("recommend", "recommend", "recommend"),
]
TRUTH_FIXES = [("India", "sidewalk"), ('"', "")]
TRUTH_FIXES_JUDGE = [("India", "sidewalk"), ('"', ""), ("'", "")]
KEYWORD_FIXES = [(".", ""), ('"', ""), ("'", "")]

EXPORT_QUESTION = "<image>\nDescribe the obstacles to the destination in a natural and simple way for a visually impaired person."
EXPORT_ROLES = ("human", "navigation assistant")
LETTER_HINT = "Answer with the option's letter from the given choices directly."
LETTER_HINT_CN = "请直接回答选项字母。"

# ---- conversation templates ----------------------------------------------------------
_POLITE = "The assistant gives helpful, detailed, and polite answers to the {}'s questions."
_HUMAN_SYSTEM = "A chat between a curious human and an artificial intelligence assistant. " + _POLITE.format("human")
_USER_SYSTEM = "A chat between a curious user and an artificial intelligence assistant. " + _POLITE.format("user")
_TAG_SYSTEM = (
    "A chat between a curious user and an artificial intelligence assistant. "
    "The assistant is able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
    "The visual content will be provided with the following format: <Image>visual content</Image>."
)
_SAFE_SYSTEM = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  "
    "Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
    "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
    "If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. "
    "If you don't know the answer to a question, please don't share false information."
)
_VISION_SYSTEM = (
    "You are a helpful language and vision assistant. "
    "You are able to understand the visual content that the user provides, "
    "and assist the user with a variety of tasks using natural language."
)
_TURN_SYSTEM = (
    "<|im_start|>system\n"
    "A conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers."
)
_DIRECT_SYSTEM = "<|im_start|>system\nAnswer the questions."

EXAMPLE_TURNS = [
    "What are the key differences between renewable and non-renewable energy sources?",
    "Renewable energy sources are those that can be replenished naturally in a relatively "
    "short amount of time, such as solar, wind, hydro, geothermal, and biomass. "
    "Non-renewable energy sources, on the other hand, are finite and will eventually be "
    "depleted, such as coal, oil, and natural gas. Here are some key differences between "
    "renewable and non-renewable energy sources:\n"
    "1. Availability: Renewable energy sources are virtually inexhaustible, while non-renewable "
    "energy sources are finite and will eventually run out.\n"
    "2. Environmental impact: Renewable energy sources have a much lower environmental impact "
    "than non-renewable sources, which can lead to air and water pollution, greenhouse gas emissions, "
    "and other negative effects.\n"
    "3. Cost: Renewable energy sources can be more expensive to initially set up, but they typically "
    "have lower operational costs than non-renewable sources.\n"
    "4. Reliability: Renewable energy sources are often more reliable and can be used in more remote "
    "locations than non-renewable sources.\n"
    "5. Flexibility: Renewable energy sources are often more flexible and can be adapted to different "
    "situations and needs, while non-renewable sources are more rigid and inflexible.\n"
    "6. Sustainability: Renewable energy sources are more sustainable over the long term, while "
    "non-renewable sources are not, and their depletion can lead to economic and social instability.\n",
]

# system, role of the human, role of the assistant, style, separators, version, example turns
_TURN_ROLES = ("<|im_start|>user\n", "<|im_start|>assistant\n")
_PLAIN = ("", "", "", "PLAIN", "\n", None, "Unknown", False)
_V0 = (_HUMAN_SYSTEM, "Human", "Assistant", "SINGLE", "###", None, "Unknown")
_USER_V1 = (_USER_SYSTEM, "USER", "ASSISTANT", "TWO", " ", "</s>", "v1", False)
_DIRECT = (_DIRECT_SYSTEM, *_TURN_ROLES, "MPT", "<|im_end|>", None, "mpt", False)
TEMPLATES = {
    "default": (*_V0, True),
    "v0": (*_V0, True),
    "v1": _USER_V1,
    "vicuna_v1": _USER_V1,
    "llama_2": (_SAFE_SYSTEM, "USER", "ASSISTANT", "LLAMA_2", "<s>", "</s>", "llama_v2", False),
    "mistral_instruct": ("", "USER", "ASSISTANT", "LLAMA_2", "", "</s>", "llama_v2", False),
    "chatml_direct": _DIRECT,
    "mistral_direct": _DIRECT,
    "plain": _PLAIN,
    "v0_plain": _PLAIN,
    "vision_v0": (*_V0, False),
    "v0_mmtag": (_TAG_SYSTEM, "Human", "Assistant", "SINGLE", "###", None, "v0_mmtag", False),
    "vision_v1": (_HUMAN_SYSTEM, "USER", "ASSISTANT", "TWO", " ", "</s>", "v1", False),
    "v1_mmtag": (_TAG_SYSTEM, "USER", "ASSISTANT", "TWO", " ", "</s>", "v1_mmtag", False),
    "vision_llama_2": (_VISION_SYSTEM, "USER", "ASSISTANT", "LLAMA_2", "<s>", "</s>", "llama_v2", False),
    "mpt": (_TURN_SYSTEM, *_TURN_ROLES, "MPT", "<|im_end|>", None, "mpt", False),
}
DEFAULT_TEMPLATE = "vicuna_v1"
TEMPLATE_FIELDS = ["system", "role0", "role1", "style", "sep", "sep2", "version", "has_examples"]
