"""The rating rubric: seven dimensions, five anchors each, and what to look at."""

from __future__ import annotations

from typing import NamedTuple


class Dimension(NamedTuple):
    name: str
    title: str
    definition: str
    anchors: tuple[tuple[str, str], ...]
    features: tuple[str, ...]
    task: str


#: Names, wording and features of the rubric, anchors from 1 to 5.
DIMENSIONS = (
    Dimension(
        "emotional_intensity", "Emotional Intensity",
        "Strength and vividness of emotional expression, from flat/monotone to vivid/expressive.",
        (
            ("Flat", "No discernible emotional expression; completely monotone delivery with minimal pitch variation, narrow intensity range, and no voice quality modulation."),
            ("Subdued", "Slight emotional coloring but largely restrained; minor pitch movement and limited dynamic range."),
            ("Moderate", "Clearly present emotional expression with noticeable prosodic variation; appropriate for neutral conversational contexts."),
            ("Expressive", "Strong emotional delivery with wide pitch range, dynamic intensity, and clear voice quality changes that convey the intended emotion."),
            ("Vivid", "Highly expressive with maximal appropriate use of prosodic, voice quality, and temporal cues; emotionally compelling and engaging."),
        ),
        ("pitch_variation_mean", "intensity_variation_mean", "jitter", "shimmer", "speech_rate_variation", "vowel_space_area"),
        "Assess the emotional intensity of this utterance. Examine pitch variation (wide range suggests high intensity), intensity dynamics, voice quality perturbations (jitter/shimmer), and vowel space expansion. A flat delivery will show narrow pitch range and low variation across features.",
    ),
    Dimension(
        "emotional_appropriateness", "Emotional Appropriateness",
        "Whether the expressed emotion fits the conversational context and the user's emotional state.",
        (
            ("Inappropriate", "Emotion is completely mismatched to context (e.g., cheerful delivery for condolences, aggressive tone for reassurance)."),
            ("Poorly matched", "Emotion partially conflicts with context; may get valence right but with wrong intensity or style."),
            ("Acceptable", "Emotion is generally appropriate but generic; no major mismatches but lacks nuanced adaptation to context."),
            ("Well-matched", "Emotion clearly fits the conversational context with appropriate intensity and style adjustments."),
            ("Perfectly attuned", "Emotion is precisely calibrated to the context, user state, and conversational dynamics; demonstrates sophisticated emotional intelligence."),
        ),
        ("pitch_level_mean", "pitch_slope_mean", "speech_rate", "spectral_tilt", "pause_duration_mean", "hnr"),
        "Evaluate whether the emotional delivery matches the conversational context. Consider: Does the pitch contour (rising for questions, falling for statements of sympathy) match what the context requires? Does the speech rate align with the expected emotional register? Examine the transcript and preceding turns.",
    ),
    Dimension(
        "emotional_consistency", "Emotional Consistency",
        "Coherence of emotional tone within a single response; absence of jarring emotional shifts.",
        (
            ("Incoherent", "Emotional tone changes erratically with no discernible pattern; feels like multiple speakers spliced together."),
            ("Inconsistent", "Noticeable emotional shifts that disrupt coherence; tone drifts without clear motivation."),
            ("Mostly consistent", "Generally stable emotional tone with minor fluctuations that don't significantly disrupt the message."),
            ("Consistent", "Stable emotional tone throughout with only motivated variations that serve the message."),
            ("Perfectly coherent", "Seamless emotional arc that maintains or evolves the emotional tone in a completely natural and motivated way."),
        ),
        ("pitch_variation_mean", "intensity_variation_mean", "speech_rate_variation", "spectral_tilt"),
        "Analyze the consistency of emotional expression across the utterance. Look for abrupt changes in pitch level, intensity, or speech rate that aren't motivated by the content. Compare prosodic features across the first and second halves of the utterance.",
    ),
    Dimension(
        "valence_accuracy", "Valence Accuracy",
        "Alignment of positive/negative emotional coloring with the semantic content.",
        (
            ("Inverted", "Emotional valence is opposite to content (e.g., happy-sounding delivery of sad content)."),
            ("Misaligned", "Valence direction has noticeable errors; tone sometimes contradicts the message."),
            ("Neutral/ambiguous", "Valence is not clearly positive or negative; acceptable for neutral content but lacks specificity."),
            ("Aligned", "Positive/negative coloring clearly matches the semantic content with appropriate acoustic cues."),
            ("Precisely matched", "Valence is perfectly calibrated with nuanced acoustic markers (e.g., warmth for positive, compressed spectral tilt for negative)."),
        ),
        ("pitch_level_mean", "spectral_tilt", "hnr", "f1_mean", "f2_mean", "speech_rate"),
        "Assess the valence alignment between vocal expression and semantic content. Positive emotions tend to correlate with higher pitch, brighter spectral tilt, higher HNR, and expanded vowel space. Negative emotions often show lower pitch, compressed spectral tilt, and reduced vowel space. Compare these patterns to the content's emotional valence.",
    ),
    Dimension(
        "arousal_accuracy", "Arousal Accuracy",
        "Whether the energy level matches the intended activation level of the content.",
        (
            ("Completely wrong", "Energy level is opposite to what content requires (e.g., lethargic delivery of urgent news)."),
            ("Mismatched", "Energy level is noticeably off; too high or too low for the content's activation demands."),
            ("Approximate", "Energy level is in the right general range but not precisely calibrated."),
            ("Well-calibrated", "Energy level clearly matches the activation requirements of the content."),
            ("Precisely calibrated", "Energy level is perfectly tuned with appropriate speech rate, intensity, and temporal dynamics for the content."),
        ),
        ("speech_rate", "intensity_level_mean", "pitch_variation_mean", "jitter", "shimmer", "pause_frequency"),
        "Evaluate whether the vocal energy matches the content's activation level. High arousal correlates with faster speech rate, higher intensity, wider pitch variation, and increased jitter/shimmer. Low arousal shows slower rate, lower intensity, and longer pauses. Compare the acoustic energy profile to what the content demands.",
    ),
    Dimension(
        "transition_smoothness", "Transition Smoothness",
        "Naturalness of emotional shifts across conversational turns.",
        (
            ("Jarring", "Emotional transitions are abrupt and unnatural; feels like emotional register resets between turns."),
            ("Awkward", "Transitions are noticeable and somewhat disruptive; emotional shifts happen too fast or too slow."),
            ("Acceptable", "Transitions are functional but lack subtlety; emotional shifts are present but mechanical."),
            ("Smooth", "Emotional shifts between turns are natural with appropriate bridging cues (pause, pitch reset)."),
            ("Seamless", "Emotional transitions are imperceptibly smooth; emotional arc across turns feels completely natural and human-like."),
        ),
        ("pitch_slope_mean", "pause_duration_mean", "speech_rate", "speech_rate_variation", "intensity_level_mean"),
        "Evaluate the naturalness of emotional transitions relative to the preceding conversational turns. Look for bridging cues: appropriate pauses before emotional shifts, gradual pitch adjustments, and smooth intensity changes. Abrupt resets in any parameter suggest poor transitions.",
    ),
    Dimension(
        "overall_emotional_quality", "Overall Emotional Quality",
        "Holistic judgment of emotional expressivity across all dimensions.",
        (
            ("Poor", "Emotionally unacceptable; multiple dimensions fail simultaneously, creating a fundamentally broken emotional delivery."),
            ("Below average", "Significant emotional deficiencies across multiple dimensions; delivery is tolerable but unsatisfying."),
            ("Average", "Emotionally functional; no major failures but lacks distinction or emotional engagement."),
            ("Good", "Emotionally effective; strong performance across most dimensions with minor areas for improvement."),
            ("Excellent", "Emotionally outstanding; human-level or near-human emotional expressivity across all dimensions."),
        ),
        ("pitch_level_mean", "pitch_variation_mean", "intensity_level_mean", "jitter", "shimmer", "hnr", "spectral_tilt", "speech_rate", "speech_rate_variation", "pause_duration_mean", "f1_mean", "f2_mean", "vowel_space_area"),
        "Provide a holistic assessment of emotional quality considering all acoustic features and the previous sub-dimension assessments. Weigh the relative importance of each dimension for this particular conversational context.",
    ),
)

NAMES = tuple(d.name for d in DIMENSIONS)
TITLES = {d.name: d.title for d in DIMENSIONS}
#: Lowest, highest and neutral score.
LOW, HIGH, NEUTRAL = 1.0, 5.0, 3.0
