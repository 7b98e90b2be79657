"""Texts and patterns that must be equal byte for byte.

A model that was trained on one prompt text answers another one differently, and its answers
are parsed by these markers, so prompts, labels and scores depend on every character below.
"""

# --- fixed values: markers in dialogs and generated answers -------------------------------
TURN_SEPARATOR = "[SEP]"
PROFILE_SEPARATOR = "|"
PROFILE_KEEP = ("accepted", "rejected")
PROFILE_JOINER = " | "
EMPTY_PROFILE = "None"
CONCLUSION = "Therefore"
TOPIC_MARKER = "topic is "
RESPONSE_MARKER = "### Response:"
EVAL_RESPONSE_MARKER = "###Response:"
NUMBERED_TOPIC = r"topic \d+\. "
PASSAGE_PICK = r"Passage (\d)"
PASSAGE_NUMBER = r"Passage (\d+)"
BEAM_JOINER = " | "
HIT_JOINER = "| "
NO_RECOMMENDATION_TOPICS = ("Q&A", "Music recommendation")
IGNORED_LABEL = -100
GATED_COT_PROMPT = "UDGIP2I_cot"

# --- fixed values: label texts ------------------------------------------------------------
ITEM_CONCLUSION = ' Therefore, the most suitable item is "'
TOPIC_CONCLUSION = ' Therefore, the most suitable topic is "'
PASSAGE_CONCLUSION_DIP2P_COT = " Therefore, the most relevant passages are as follows:\n"
PASSAGE_CONCLUSION_DGIP2P_COT_NEW = " Therefore, the relevant passages are as follow:\n"
NO_RELEVANT_PASSAGE = (
    "None of the passages are relevant for generating a response to the given dialog."
)

# --- fixed values: headings of candidate blocks -------------------------------------------
BLOCK_HEADING = "Here are the candidate passages about "

# --- fixed values: white space, the characters for which Unicode text stripping applies ----
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NBSP = "\xa0"

# --- fixed values: the ten prompt templates ------------------------------------------------
GUESS_PASSAGE = (
    "I will provide you with a dialog between a user and a system.\n\n{instruction}\n\n"
    "Guess which passage should be retrieved to the user for generating the response to this "
    "dialog.\n\n### Response:"
)

TEMPLATES = {
    "DIP2I": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to select the item to mention in the next response based on the provided dialog.\nFirst, I will provide a dialog between a user and the system. Then, I will provide candidate items and candidate passages describing each item.\n\nHere is the dialog:\n{instruction}\n\nHere are the candidate items:\n{input}\n\n{input2}Based on the dialog and candidate passages for each item, you can recommend an item or chat about the items that are already mentioned in the next response.\n\nAmong the candidate items, select the most suitable item to be mentioned in the next response.\n\n### Response:",
        "prompt_no_input": GUESS_PASSAGE,
        "response_split": "### Response:",
    },
    "DIP2I_cot": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to select the item to mention in the next response based on the provided dialog.\nFirst, I will provide a dialog between a user and the system. Then, I will provide candidate items and candidate passages describing each item.\n\nHere is the dialog:\n{instruction}\n\nHere are the candidate items:\n{input}\n\n{input2}Based on the dialog and candidate passages for each item, you can recommend an item or chat about the items that are already mentioned in the next response.\n\nAmong the candidate items, select the most suitable item to be mentioned in the next response.\nYou should first give the rationale, then select the item.\n\n### Response:",
        "prompt_no_input": GUESS_PASSAGE,
        "response_split": "### Response:",
    },
    "DIP2P": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to select the most relevant passage for generating a response to the given dialog.\nFirst, I will provide a dialog between a user and the system. Then, I will provide the candidate item and candidate passages describing that item.\n\nHere is the dialog:\n{instruction}\n\nHere is the item:\n{input}\n\nHere are the passages:\n{input2}\n\nBy referring to the dialog context and the passages, select the most relevant passage for the next response from the passage list. You should select the relevant passages in order of relevance.\n\n### Response:",
        "prompt_no_input": GUESS_PASSAGE,
        "response_split": "### Response:",
    },
    "DIP2P_cot": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to select the most relevant passage for generating a response to the given dialog.\nFirst, I will provide a dialog between a user and the system. Then, I will provide the candidate item and candidate passages describing that item.\n\nHere is the dialog:\n{instruction}\n\nHere is the item:\n{input}\n\nHere are the passages:\n{input2}\n\nBy referring to the dialog context and the passages, select the most relevant passage for the next response from the passage list. You should first give the rationale, then select the relevant passages in order of relevance.\n\n### Response:",
        "prompt_no_input": GUESS_PASSAGE,
        "response_split": "### Response:",
    },
    "DP2R_inspired": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to generate the response to the given dialog.\n\nFirst, I will present a dialog between a user and the system. Then, I will provide relevant passages for reference.\n\nHere is the dialog:\n{instruction}\n\nHere are the relevant passages:\n{input}\n\nGenerate a response that the system should provide. You should refer to the keywords in the relevant passages to generate the response.\n\n### Response:",
        "prompt_no_input": "Pretend you are a conversational recommender system. Your task is to generate the response to the given dialog.\n\nFirst, I will present a dialog between a user and the system.\n\nHere is the dialog:\n{instruction}\n\nGenerate a response that the system should provide.\n\n### Response:",
        "response_split": "### Response:",
    },
    "UDGIP2I_new": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to decide the topic (item or entity) to mention in the next response based on the provided dialog.\n\nFirst, I will provide a dialog between a user and the system, along with the user's profile and the goal of response generation. Then, I will provide candidate topics and candidate passages describing each topic.\n\nHere is the profile:\n{input4}\n\nHere is the dialog:\n{instruction}\n\nHere is the goal:\n{input}\n\nHere are the candidate topics:\n{input2}\n\n{input3}Based on the user profile, dialog, and candidate passages for each topic, determine the most suitable topic for the response.\n\n### Response:",
        "prompt_no_input": GUESS_PASSAGE,
        "response_split": "### Response:",
    },
    "UDGIP2I_cot": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to decide the topic (item or entity) to mention in the next response based on the provided dialog.\n\nFirst, I will provide a dialog between a user and the system, along with the user's profile and the goal of response generation. Then, I will provide candidate topics and candidate passages describing each topic.\n\nHere is the profile:\n{input4}\n\nHere is the dialog:\n{instruction}\n\nHere is the goal:\n{input}\n\nHere are the candidate topics:\n{input2}\n\n{input3}Based on the user profile, dialog, and candidate passages for each topic, determine the most suitable topic for the response. You should first give the rationale, then answer the topic.\n\n### Response:",
        "prompt_no_input": GUESS_PASSAGE,
        "response_split": "### Response:",
    },
    "DGIP2P_new": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to select the most relevant passage for generating a response to the given dialog.\n\nFirst, I will provide a dialog between a user and the system, along with the goal of response and topic of response. Then, I will provide candidate passages describing the topic.\n\nHere is the dialog:\n{instruction}\n\nHere is the goal:\n{input}\n\nHere is the topic:\n{input2}\n\nHere are the passages:\n{input3}\n\nBy referring to the dialog context and the passages, select the most relevant passage for the next response from the passage list.\n\n### Response:",
        "prompt_no_input": GUESS_PASSAGE,
        "response_split": "### Response:",
    },
    "DGIP2P_cot_new": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to select the relevant passages for generating a response to the given dialog.\n\nFirst, I will provide a dialog between a user and the system, along with the goal of response and topic of response. Then, I will provide candidate passages describing the topic.\n\nHere is the dialog:\n{instruction}\n\nHere is the goal:\n{input}\n\nHere is the topic:\n{input2}\n\nHere are the passages:\n{input3}\n\nBy referring to the dialogue context and the passages, select the relevant passages for the next response from the passage list. You should first provide the rationale, then select the relevant passages in order of relevance.\n\n### Response:",
        "prompt_no_input": GUESS_PASSAGE,
        "response_split": "### Response:",
    },
    "DGP2R": {
        "prompt_input": "Pretend you are a conversational recommender system. Your task is to generate the response to the given dialog.\n\nFirst, I will provide a dialog between a user and the system, along with the goal of response and topic of response. Then, I will provide relevant passages describing the topic.\n\nHere is the dialog:\n{instruction}\n\nHere is the goal:\n{input}\n\nHere are the relevant passages:\n{input2}\n\nFormulate a response that the system should give. You should refer to the keywords in the relevant passages to generate the response.\n\n### Response:",
        "prompt_no_input": "",
        "response_split": "### Response:",
    },
}
