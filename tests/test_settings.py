from sieveline.operators import records, settings


def test_presets_and_overlay():
    made = settings.overlaid(settings.PRESETS["balanced_signal"], {"weights": {"esg_alignment": 0.5}, "weighting_mode": "equal"})
    assert made["weights"]["esg_alignment"] == 0.5 and made["weights"]["base_quality"] == 0.25 and made["weighting_mode"] == "equal"
    assert settings.PRESETS["balanced_signal"]["weights"]["esg_alignment"] == 0.20


def test_saved_profiles(tmp_path):
    store = settings.Profiles(str(tmp_path / "p.json"))
    assert [store.save("My Profile", {"a": 1}, "1"), store.save("my profile!", {}, "2")] == ["my-profile", "my-profile-2"]
    store.save("My Profile", {"a": 2}, "3", "my-profile")
    assert [k for k, _ in store.listed()] == ["my-profile", "my-profile-2"] and store.get("my-profile")["settings"] == {"a": 2} and store.get("my-profile")["created"] == "1"
    store.save("B", {}, "3")
    store.save("A", {}, "3")
    assert [k for k, _ in store.listed()][:3] == ["b", "a", "my-profile"] and store.save("!!", {}, "0") == "custom-profile"
    assert store.save("New", {}, "4", "gone") == "new" and store.get("new")["description"] is None
    assert store.delete("my-profile") and not store.delete("my-profile") and store.get("my-profile") is None


def test_warnings():
    assert records.warnings({"esg": "neutral", "technicals": "prefer_high"}, {"technicals": False}, ("ambiguous",)) == ["no_technicals_metrics", "ambiguous_universe"]
