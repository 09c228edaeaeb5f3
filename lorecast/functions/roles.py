"""Who speaks in a message: roles as the tables spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorecast.functions.keys import BLANK

# Spellings of the roles.
ROLES = {
    "user": ("user", "human", "customer", "learner", "student", "client", "usr", "u", "h", "用户", "用戶", "使用者", "人类", "学生", "学员", "benutzer", "nutzer", "benutzerin", "mensch", "utilisateur", "utilisatrice", "usager", "humain", "élève"),
    "assistant": ("assistant", "bot", "ai", "agent", "model", "chatbot", "gpt", "asst", "a", "tutor", "助手", "助理", "机器人", "人工智能", "模型", "assistent", "ki", "assistente", "ia", "modèle"),
    "system": ("system", "sys", "developer", "系统", "系統", "système", "systeme", "anweisung"),
}


def readable_role(role: Column) -> Column:
    """user, assistant or system in any known spelling; null if the role can't be read."""
    bare = F.lower(F.regexp_replace(role, f"[{BLANK}\\p{{Punct}}：]+", ""))
    found = F.lit(None).cast("string")
    for name, spellings in ROLES.items():
        found = F.when(bare.isin(*spellings), name).otherwise(found)
    return found
