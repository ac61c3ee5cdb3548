"""Constants of the domain, in one place."""

# Fixed values.
SOFTMAX_LEAST = 0.9
RANK_POOL = 1000
MIDDLE_AUTHOR = 0.75
SCALE_LOW, SCALE_HIGH = 0.5, 1.0
STRONG_COAUTHOR = 0.005
EDGE_PRUNE, EDGE_PRUNE_RETRY = 0.02, 0.05
SIMILAR_LAST, SIMILAR_ANY, TERMS_KEPT, SHORT_LIST = 0.6, 0.75, 20, 5
WARD_THRESHOLD, PERSONA_PAPERS = 88.0, 4
CANDIDATE_PAPERS, TERMS_LEAST, ENOUGH_DATA = 6, 10, 10
SPLIT_ITERATIONS = 8
VENUE_RATIO, VENUES_LEAST, RING = 0.2, 3, (3, 6)
YEARS = (2015, 2022)
UPPER_SHARE = 0.75
LABELS = ("Task", "Method", "Material", "Metric")
DOCTYPE_ORDER = ("Journal", "Conference", "Book", "BookChapter", "Repository", "Dataset")
METHOD_WORDS = (
    "algorithm method approach technique framework model system neural network deep learning machine statistical regression classification clustering "
    "optimization search genetic evolutionary bayesian probabilistic stochastic deterministic heuristic supervised unsupervised reinforcement semi-supervised "
    "convolutional recurrent transformer attention encoder decoder feature extraction selection engineering preprocessing training testing validation "
    "cross-validation evaluation metric measure score accuracy precision recall f1 loss function objective cost penalty regularization gradient descent "
    "backpropagation forward backward linear nonlinear kernel support vector decision tree random forest ensemble boosting bagging voting"
).split()
TASK_WORDS = (
    "task problem application domain field area research recognition detection identification classification prediction estimation generation synthesis "
    "analysis processing understanding parsing segmentation clustering matching alignment retrieval recommendation ranking scoring filtering selection "
    "language speech vision image video text document sentiment emotion opinion stance aspect topic theme semantic syntactic morphological phonetic lexical "
    "translation summarization simplification completion question answering dialogue conversation chatbot assistant knowledge graph extraction construction "
    "reasoning inference entailment contradiction paraphrase similarity"
).split()
#: Words that a term loses at its end where terms are merged, in the order in which they go (one comes up twice).
GENERIC_TAILS = (
    "component", "block", "module", "task", "methodology", "component", "technology", "mechanism", "approach", "method", "technique", "framework", "system", "model",
    "algorithm", "procedure",
)
METHOD_PATTERNS = ("method", "algorithm", "model", "framework", "approach")
IN_TERM, IN_CONTEXT, TIE_WORDS = 1.0, 0.5, 2
SUFFIXES = ("-based", "-driven", "-aware", "-free", "tion", "sion", "ness", "ment")
PREFIXES = ("multi-", "semi-", "auto-", "self-", "cross-", "meta-")
